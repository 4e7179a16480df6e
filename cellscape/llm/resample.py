"""Operator 12: importance resampling of documents towards the texts of a target.

Hashed n-gram counts of the corpus and of the target give every bucket a gain, the log of
how much likelier the target is to say it; a document's weight is the mean gain of its
n-grams, and a draw without replacement adds one Gumbel number to each weight and takes the
highest sums.  Texts are cut with Arrow kernels: lower case, split, flatten, dictionary;
n-grams are shifted dictionary indices, and only distinct ones are hashed.

Two passes over the texts, one to count and one to weigh; neither shuffles a text.  Ranks
come from a range sort of the drawn rows and the sizes of its partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscape.llm import tokens
from cellscape.session import stored

LONGEST = 1              # words of the longest n-gram
BUCKETS = 10_000
LEAST_WORDS = 20         # shorter documents are never drawn
SHARE = (10, 100)        # of the documents that are long enough
SEED = "2024"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # after A-Z are lower-cased
STEP = 1024              # scores are counted in steps of so many before they are counted one by one


def hashed(texts: pa.Array, longest: int, buckets: int):
    """Buckets of all n-grams, by n: pairs (bucket per n-gram, first n-gram of each text, n + 1 numbers).

    NULL has no words.
    """
    words = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), NOT_A_WORD)
    coded = pc.dictionary_encode(pc.list_flatten(words))
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy(zero_copy_only=False)
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    full = np.array([bool(w) for w in spelled], dtype=bool)[at]      # what is split off at either end is no word
    bounds = np.concatenate([[0], np.cumsum(full)])[offsets]
    at = at[full].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    sums = np.array([zlib.crc32(w) for w in spelled], dtype=np.int64)
    out, gram = [(sums[at] % buckets, bounds)], at
    for n in range(2, longest + 1):
        inside = text[n - 1 :] == text[: max(0, len(text) - n + 1)]   # where the run does not leave its text
        pairs, gram = np.unique(gram[: len(inside)] * len(spelled) + at[n - 1 :], return_inverse=True)
        sums = np.array([zlib.crc32(b" " + spelled[p % len(spelled)], int(sums[p // len(spelled)])) for p in pairs.tolist()], dtype=np.int64)
        lengths = np.maximum(np.diff(bounds) - n + 1, 0)
        out.append((sums[gram[inside]] % buckets, np.concatenate([[0], np.cumsum(lengths)])))
    return out


def _counting(longest: int, buckets: int):
    def run(parts):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in parts:
            for _, texts in tokens.batches(batch.column(0)):
                for bucket, _ in hashed(texts, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        said = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(said.astype(np.int32)), pa.array(total[said])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the n-grams of all texts fall into each bucket; buckets without any have no row.

    texts: text.  A task sends one row per bucket at most, however many texts it reads.
    """
    rows = texts.select(F.col("text").cast("string")).mapInArrow(_counting(longest, buckets), "bucket int, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln) of the smoothed ratio of target to corpus.

    corpus, target: what bucket_counts returns.
    """
    spark = corpus.sparkSession
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    big, small = total(corpus), total(target)
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    one = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1.0
    ratio = one("t") * F.lit(big + buckets) / (one("s") * F.lit(small + buckets))
    return rows.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def _weighing(gains: np.ndarray, longest: int):
    def run(parts):
        for batch in parts:
            for start, texts in tokens.batches(batch.column(1)):
                total, n, words = 0, 0, None
                for bucket, bounds in hashed(texts, longest, len(gains)):
                    gained = np.concatenate([[0], np.cumsum(gains[bucket])])
                    total, n = total + gained[bounds[1:]] - gained[bounds[:-1]], n + np.diff(bounds)
                    words = np.diff(bounds) if words is None else words
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array(np.where(n > 0, total // np.maximum(n, 1), 0).astype(np.int64)),
                ], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A Gumbel number times 1000, floored, from the first 8 hex digits of sha256(seed:id); a NULL id is empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def least_drawn(scores: DataFrame, draw: int) -> int | None:
    """The lowest score among the `draw` highest; None if there are fewer rows or none is drawn.

    Counts by steps of STEP first, then by score within one step.  Gains and noise are logarithms
    of 64-bit counts and 32-bit numbers, so scores span less than 200,000 and steps less than 200.
    """
    if draw <= 0:
        return None
    above, step = 0, F.floor(F.col("score") / STEP)
    for level, rows in ((step, lambda s: scores.where(step == s)), (F.col("score"), None)):
        found = None
        for r in sorted(scores.groupBy(level.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["at"]):
            if above + r["n"] >= draw:
                found = r["at"]
                break
            above += r["n"]
        if found is None:
            return None
        scores = rows(found) if rows else scores
    return found


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows (doc_id, score, at and others) with `rank`: 1 for the highest score, ties to the smaller doc_id, NULL beyond `draw`.

    Sorted by range; a rank is the place within a partition plus the rows of the partitions before it.
    """
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    # One row per partition of the sort.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    out = placed.withColumn("_part", part).join(ahead, "_part")
    return out.withColumn("rank", F.col("_ahead") + place + 1).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("_part", "_place", "_ahead")


def drawn(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
          share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (NULL: not drawn).

    docs: doc_id, text; target: text; other columns are not read.  Of the N documents with
    `least_words` words or more, floor(N * share) of the highest scores are drawn.  NULL and empty
    texts have no features and weight 0; without target texts all gains are those of zero counts.
    Repeated rows are documents of their own: equal scores go to the smaller doc_id, rows of one
    doc_id (NULL ids last) in any order, each with its own rank.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    corpus = stored(bucket_counts(src, longest, buckets), "corpus")
    table = bucket_gains(corpus, stored(bucket_counts(target, longest, buckets), "target"), buckets)
    gains = np.zeros(buckets, dtype=np.int64)
    for r in table.collect():        # one row per bucket
        gains[r["bucket"]] = r["gain"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = src.mapInArrow(_weighing(gains, longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    rows = stored(rows.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("at", F.monotonically_increasing_id()), "weighed")
    long_enough = F.col("n_words") >= least_words
    draw = rows.where(long_enough).count() * share[0] // share[1]
    least = least_drawn(rows.where(long_enough).select("score"), draw)
    inside = long_enough & (F.col("score") >= least) if least is not None else F.lit(False)
    columns = "doc_id", "n_features", "weight", "score", "rank"
    return ranked(rows.where(inside), draw).select(*columns).unionByName(
        rows.where(~inside).withColumn("rank", F.lit(None).cast("long")).select(*columns))
