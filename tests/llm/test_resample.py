"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib

import pytest

from cellscape.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest, buckets, least, share, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x, longest)[1]:
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        words, found = grams(x, longest)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * share[0] // share[1]], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest, buckets, least, share", [(1, 10000, 20, (10, 100)), (2, 50, 3, (1, 2)), (3, 997, 0, (1, 1)), (1, 7, 5, (0, 1))])
def test_equals_plain_draw(spark, longest, buckets, least, share):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "Ünï", "x1", "日本", "ω", "B"]
    texts = ["", None, " ,; ", "one", "A\x00b\x7fc--d", "É é"] + [rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]
    docs = list(enumerate(texts)) + [(None, "beta " * 30), (None, "beta " * 30), (9, texts[9]), (10, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS score", "3 AS n_words", "'x' AS rank").repartition(3)
    target = ["Alpha beta gamma", None, "", "x1 x1 x1"]
    bench = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 AS bucket")
    got = resample.drawn(df, bench, longest, buckets, least, share, "s")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows, want = [tuple(r) for r in got.collect()], plain(docs, target, longest, buckets, least, share, "s")
    # Rows of one doc_id with equal scores share their ranks in any order.
    assert sorted(rows, key=repr) == want
    ranks = sorted(r[4] for r in rows if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.drawn(docs, full).count() == 0
    assert [tuple(r)[1] for r in resample.drawn(full, docs, least_words=1, share=(1, 1)).collect()] == [3]
    assert resample.drawn(full, full, least_words=1, share=(1, 1)).first()["rank"] == 1


def test_scores_in_one_step(spark):
    scores = spark.createDataFrame([(s,) for s in [5, 5, 5, -1, -1030, 2000]], "score long")
    assert [resample.least_drawn(scores, d) for d in range(8)] == [None, 2000, 5, 5, 5, -1, -1030, None]
