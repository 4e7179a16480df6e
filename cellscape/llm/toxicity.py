"""Operator 4: toxicity by compression distance with two zstandard dictionaries.

The ordinary dictionary is trained on ordinary text.  The toxic one holds the same content
and, before it, what toxic texts say in many different surroundings and ordinary ones do
not.  A window (one word, unless asked otherwise) is compressed with both; the bytes that
the toxic dictionary saves are its distance.  A text is scored by how many of its windows
save at least a calibrated number of bytes.

Every window is compressed between two fixed pieces that both dictionaries hold: a bare
word would be stored as it is, and the compressor does not search the last bytes of its input.

The fit learns from all labelled rows in passes over the stored texts: tasks send what is
counted or trained on their texts (pieces, dictionaries, stretches, hits), never texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm import labels as labelled
from cellscape.llm import opened, shipped, tokens
from cellscape.session import drop_stored, large, stored

ORDINARY_BYTES = 16_000        # of the ordinary dictionary
TOXIC_BYTES = 16_000           # of the toxic content
GRAM = 6                       # bytes of the pieces that are counted
SURE = 12.0                    # log-likelihood ratio from which a piece counts as toxic, at least
TIMES = 4                      # so many times the share of ordinary text; half of it in bare counts to be looked at
SAVINGS = (2, 3, 4, 5, 6)      # bytes saved that a threshold is chosen from
LEVEL = 12
CACHE = 400_000                # words whose distance a task remembers
AT_ONCE = 4 << 20              # bytes of text that a task counts or trains on together
BEFORE, AFTER = b"\x01start of a window\x02 in both dictionaries\x02", b"\x03end of a window\x04"


def normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode().split()) + b" "


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece at each place, valid): pieces that do not reach into a second word are valid."""
    pad = b"\x00" * 8
    a = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    wide = a.astype(np.int64)
    n = len(a) - GRAM + 1
    piece = np.zeros(n, np.int64)
    for k in range(GRAM):
        piece = piece * 257 + wide[k : k + n]
    ends = np.concatenate([[0], np.cumsum(a == 0)])
    gaps = np.concatenate([[0], np.cumsum(a == 32)])
    valid = (ends[GRAM:] == ends[:-GRAM])[:n] & (gaps[GRAM - 1 : n + GRAM - 1] == gaps[1 : n + 1])
    return a, piece, valid


def _around(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes before and after the pieces at these places."""
    out = np.zeros(len(at), np.uint64)
    for k in (*range(-8, 0), *range(GRAM, GRAM + 8)):
        place = at + k
        inside = (place >= 0) & (place < len(a))
        out = out * np.uint64(257) + np.where(inside, a[np.clip(place, 0, len(a) - 1)], 0).astype(np.uint64)
    return tokens.mix(out).view(np.int64)


def _grouped(parts):
    """Batches of (text, label) as lists of normal texts by label, about AT_ONCE bytes each."""
    kept, size = {0: [], 1: []}, 0
    for batch in parts:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            kept[label].append(normal(text))
            size += len(kept[label][-1])
            if size >= AT_ONCE:
                yield kept
                kept, size = {0: [], 1: []}, 0
    if size:
        yield kept


def _occurring(parts):
    """piece, label, n: how often a piece occurs in a batch of texts."""
    for texts in _grouped(parts):
        for label in (0, 1):
            _, piece, valid = _pieces(texts[label])
            kinds, n = np.unique(piece[valid], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(kinds), label, np.int32)), pa.array(n.astype(np.int64))], names=["piece", "label", "n"])


def _surrounded(shared):
    """piece, label, around: the different surroundings of the shared pieces in a batch of texts."""
    def run(parts):
        wanted = opened(shared)
        for texts in _grouped(parts):
            for label in (0, 1):
                a, piece, valid = _pieces(texts[label])
                at = np.flatnonzero(valid & _among(piece, wanted))
                pairs = np.unique(np.column_stack([piece[at], _around(a, at)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(np.full(len(pairs), label, np.int32)), pa.array(pairs[:, 1])], names=["piece", "label", "around"])
    return run


def _among(piece: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which pieces are among the wanted ones, which are sorted."""
    if not len(wanted):
        return np.zeros(len(piece), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, piece), len(wanted) - 1)] == piece


def _stretches(shared):
    """stretch, digest of the text, times: stretches of words made of the shared pieces."""
    def run(parts):
        good = opened(shared)
        for texts in _grouped(parts):
            rows = []
            for text in texts[1]:
                a, piece, valid = _pieces([text])
                cover = np.zeros(len(a) + 1, dtype=np.int64)
                where = np.flatnonzero(valid & _among(piece, good))
                np.add.at(cover, where, 1)
                np.add.at(cover, where + GRAM, -1)
                edge = np.diff(np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]]).astype(np.int8))
                raw, digest = a.tobytes(), hashlib.blake2b(text, digest_size=16).digest()
                found = Counter(raw[s:e] for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
                rows += [(stretch, digest, times) for stretch, times in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("stretch", "digest", "times"), r)) for r in rows], schema=pa.schema(
                [("stretch", pa.binary()), ("digest", pa.binary()), ("times", pa.int64())]))
    return run


def toxic_pieces(told: DataFrame, texts: int) -> np.ndarray:
    """The pieces that are sure to mark toxic text, sorted.

    told: text, label.  texts: how many of them are toxic; the more, the more pieces look sure by chance.
    Pieces are counted by their different surroundings, so copies of a text count once.  Only pieces
    that occur in toxic text at half the wanted share at least have them looked at.
    """
    spark = told.sparkSession
    counts = told.mapInArrow(_occurring, "piece long, label int, n long").groupBy("piece").agg(
        *[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)])
    counts = stored(counts, "pieces")
    all_ = counts.agg(F.sum("n0").alias("there"), F.sum("n1").alias("here")).first()
    here, there = float(max(1, all_["here"] or 0)), float(max(1, all_["there"] or 0))
    share = F.col("n1") / F.lit(here) > F.lit(TIMES / 2) * (F.col("n0") + 0.5) / F.lit(there)
    wanted = np.sort(np.array([r["piece"] for r in counts.where(F.col("n1") >= 3).where(share).select("piece").collect()], dtype=np.int64))
    drop_stored(counts)
    if not len(wanted):
        return wanted
    pairs = told.mapInArrow(_surrounded(shipped(spark, wanted)), "piece long, label int, around long").distinct()
    x, seen = F.count_if(F.col("label") == 1).cast("double").alias("x"), F.count_if(F.col("label") == 0).cast("double").alias("seen")
    both = (F.col("x") + F.col("seen")) / F.lit(here + there)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (both * F.lit(of)))).otherwise(F.lit(0.0))
    sure = max(SURE, min(40.0, SURE + texts / 50))
    good = pairs.groupBy("piece").agg(x, seen).where(2 * (part(F.col("x"), here) + part(F.col("seen"), there)) > sure).where(
        F.col("x") / F.lit(here) > F.lit(float(TIMES)) * (F.col("seen") + 0.5) / F.lit(there))
    return np.sort(np.array([r["piece"] for r in good.select("piece").collect()], dtype=np.int64))


def toxic_content(told: DataFrame, good: np.ndarray) -> bytes:
    """Stretches of words made of the good pieces, the commonest last, as many as the dictionary holds."""
    content = b""
    if not len(good):
        return content
    found = told.where("label = 1").mapInArrow(_stretches(shipped(told.sparkSession, good)), "stretch binary, digest binary, times long")
    found = found.distinct().groupBy("stretch").agg(F.sum("times").alias("times")).where("times >= 3")
    for row in found.orderBy(F.desc("times"), "stretch").toLocalIterator():
        stretch = bytes(row["stretch"])
        if stretch not in content and len(content) + len(stretch) < TOXIC_BYTES:
            content = stretch + b"\n" + content
        if len(content) + GRAM >= TOXIC_BYTES:
            break
    return content


def _trained(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of these texts, cut into groups of four words."""
    words = [b" " + b" ".join(w) + b" " for t in texts for split in [t.split()] for w in [split[i : i + 4] for i in range(0, len(split), 4)]]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, words, k=50, d=8).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: take it as it is
        return b"".join(words)[-ORDINARY_BYTES:]


def _merged(contents: list[bytes]) -> bytes:
    """One dictionary of what the dictionaries of all parts hold."""
    return _trained(contents) if len(contents) > 1 else b"".join(contents)


def _dictionaries(parts):
    """A dictionary for each part of the texts, of all its text."""
    made = []
    for texts in _grouped(parts):
        made.append(_trained(sorted(set(texts[0]))))
        if len(made) == 16:
            made = [_merged(made)]
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([_merged(made)], pa.binary())], names=["content"])


def ordinary_content(told: DataFrame) -> bytes:
    """The ordinary dictionary: trained on the texts of each part, then on what these dictionaries hold."""
    rows = told.where("label = 0").mapInArrow(_dictionaries, "content binary").collect()
    return _merged(sorted(bytes(r["content"]) for r in rows))


class Distance:
    """Bytes that the toxic dictionary saves on each window of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes, width: int):
        self.contents, self.width, self.known, self.packers = (ordinary, toxic + ordinary), width, {}, None

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "packers": None}

    def of(self, window: bytes) -> int:
        if self.packers is None:
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=128, dict_size=32768, min_match=3, write_content_size=0, write_checksum=0,
                write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            dicts = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in self.contents]
            for d in dicts:
                d.precompute_compress(compression_params=how)
            self.packers = [zstandard.ZstdCompressor(dict_data=d, compression_params=how) for d in dicts]
        saved = self.known.get(window)
        if saved is None:
            framed = BEFORE + window + AFTER
            saved = len(self.packers[0].compress(framed)) - len(self.packers[1].compress(framed))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[window] = saved
        return saved

    def counts(self, text: str | None) -> list[int]:
        """How many windows save at least each of SAVINGS bytes."""
        words = (text or "").lower().encode().split()
        if self.width == 1:
            saved = [self.known.get(b" " + w + b" ") for w in words]
            saved = [self.of(b" " + w + b" ") if s is None else s for s, w in zip(saved, words)]
        else:
            saved = [self.of(b" " + b" ".join(words[i : i + self.width]) + b" ") for i in range(0, len(words), self.width)]
        return [sum(s >= k for s in saved) for k in SAVINGS]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression on rows that count n times (the last one is the constant), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


class Model:
    """Distance, the threshold in bytes, and the weights of the score."""

    def __init__(self, distance: Distance | None, column: int, weights: np.ndarray):
        self.distance, self.column, self.weights = distance, column, weights

    def inputs(self, counts: np.ndarray) -> np.ndarray:
        return self.features(counts[:, self.column])

    @staticmethod
    def features(hits: np.ndarray) -> np.ndarray:
        return np.column_stack([hits >= 1, hits >= 2, np.log1p(hits)]).astype(float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(texts), self.weights[-1])
        counts = np.array([self.distance.counts(t) for t in texts], dtype=float).reshape(len(texts), len(SAVINGS))
        x = np.column_stack([self.inputs(counts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _hits(shared):
    """saving, hits, label, n: how many texts have so many windows that save at least so many bytes."""
    def run(parts):
        distance = opened(shared)
        for batch in parts:
            counts = [distance.counts(t) for t in batch.column("text").to_pylist()]
            found = Counter((k, hits, label) for row, label in zip(counts, batch.column("label").to_pylist()) for k, hits in enumerate(row))
            rows = np.array([(*key, n) for key, n in found.items()], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["saving", "hits", "label", "n"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", width: int = 1) -> Model:
    """Train the dictionaries and calibrate the threshold on all labelled rows that are not held out.

    Three quarters of them make the dictionaries and the others the calibration; all make both
    if there are few rows or the others lack a label.  Without rows of both labels every score
    is the share of label 1 (0 without any).
    """
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~labelled.held_out())
    told = large(texts).join(labelled.known(labels, label), "doc_id")    # labels grow with the texts
    rows = stored(told.select("text", "label", (F.pmod("doc_id", F.lit(4)) != 3).alias("learn")), "labelled")
    number = {(r["label"], r["learn"]): r["count"] for r in rows.groupBy("label", "learn").count().collect()}
    have = [sum(n for (k, _), n in number.items() if k == y) for y in (0, 1)]
    if not all(have):
        drop_stored(rows)
        return Model(None, 0, np.array([have[1] / max(1, sum(have))]))
    learn = rows.where("learn") if sum(have) >= 40 else rows
    fresh = rows.where("NOT learn") if sum(have) >= 40 and all((y, False) in number for y in (0, 1)) else rows
    learn, fresh = learn.select("text", "label"), fresh.select("text", "label")
    texts = learn.where("label = 1").select(F.count_distinct(F.md5(F.coalesce("text", F.lit(""))))).first()[0]
    toxic = toxic_content(learn, toxic_pieces(learn, texts))
    distance = Distance(ordinary_content(learn) + BEFORE + AFTER, toxic, width)
    seen = fresh.mapInArrow(_hits(shipped(docs.sparkSession, distance)), "saving long, hits long, label long, n long").groupBy("saving", "hits", "label").agg(
        F.sum("n").alias("n")).orderBy("saving", "hits", "label").collect()
    drop_stored(rows)
    best = None
    for column in range(len(SAVINGS)):
        of = np.array([(r["hits"], r["label"], r["n"]) for r in seen if r["saving"] == column], dtype=float)
        x, y, n = Model.features(of[:, 0]), of[:, 1], of[:, 2]
        model = Model(distance, column, _logistic(x, y, n))
        p = np.clip(1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ model.weights, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / n.sum()
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def _scored(shared):
    def run(parts):
        model = opened(shared)
        for batch in parts:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    docs: doc_id, text; other columns are not read.  Whole texts are scored; NULL, empty and
    blank texts have no windows and get the lowest score.  Repeated rows score alike; a
    NULL doc_id stays NULL and is not held out.
    """
    shared = shipped(docs.sparkSession, model)  # two dictionaries of fixed size
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
