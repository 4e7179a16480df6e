"""Operator 11: vectors as short codes, k-means on integers with adaptive distance bounds.

Every part of a vector keeps the squared distance's bounds between rounds: an upper bound
to its own entry, the b entries that came next with a lower bound each, in order, and one
outer bound below all other entries.  After a round the bounds are widened by how far the
entries moved; a part whose upper bound stays below the first lower bound keeps its entry
unseen.  The rest are settled with integer distances to as many of the b entries as the
bounds leave open, or to all.  b starts at a quarter of the entries and shrinks, to an
eighth at least, to what nearly all unsettled parts needed.

A round is one pass: it reads the written rows of the round before, writes them with new
codes and bounds, and ends each task with its sums per part and entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.session import drop_stored, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
COVERED = 0.95           # share of unsettled parts whose open entries b must hold
CHUNK = 4096             # vectors that are compared at once


def usable(vector: str = "embedding"):
    """Vectors that take part: neither they nor a component is NULL, all components are finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); refused where sums of squared distances would not fit a long."""
    y = np.floor(scale * x)
    if x.size and (4 * np.abs(y).max() ** 2 + 1) * x.shape[1] >= 2.0**62:
        raise ValueError("components are too large for integer distances")
    return y.astype(np.int64)


def up(x: np.ndarray) -> np.ndarray:
    """As float32, never below the value."""
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * np.where(x > 0, 1 - 1e-9, 1 + 1e-9)).astype(np.float32), np.float32(-np.inf))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to its own rows of entries (n, m, d), as integers."""
    return ((x[:, None] - entries) ** 2).sum(2)


class Bounds:
    """Codes and bounds of one part position of a batch."""

    def __init__(self, own, high, near, low, outer):
        self.own, self.high, self.near, self.low, self.outer = own, high, near, low, outer

    @classmethod
    def first(cls, x: np.ndarray, book: np.ndarray, b: int) -> "Bounds":
        n, k = len(x), len(book)
        out = cls(np.zeros(n, np.uint8), np.zeros(n, np.float32), np.zeros((n, b), np.uint8), np.zeros((n, b), np.float32), np.zeros(n, np.float32))
        out.search(x, book, np.arange(n))
        return out

    def search(self, x: np.ndarray, book: np.ndarray, rows: np.ndarray) -> None:
        """Compare these rows with every entry."""
        b, k = self.near.shape[1], len(book)
        for i in range(0, len(rows), CHUNK):
            at = rows[i : i + CHUNK]
            d = distances(x[at], np.broadcast_to(book, (len(at), *book.shape)))
            order = np.argsort(d, axis=1, kind="stable")   # equal distances stay in the order of the entries
            root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            self.own[at], self.high[at] = order[:, 0], up(root[:, 0])
            self.near[at], self.low[at] = order[:, 1 : b + 1], down(root[:, 1 : b + 1])
            self.outer[at] = down(root[:, b + 1]) if k > b + 1 else np.inf

    def move(self, moved: np.ndarray) -> None:
        """Widen every bound by how far the entries moved."""
        far = moved.max(initial=0.0)
        self.high = up(self.high.astype(np.float64) + moved[self.own])
        self.low = down(self.low.astype(np.float64) - moved[self.near])
        self.outer = down(self.outer.astype(np.float64) - far)
        for i in range(self.low.shape[1] - 1, -1, -1):   # in order again, each also below what follows
            self.low[:, i] = np.minimum(self.low[:, i], self.low[:, i + 1] if i + 1 < self.low.shape[1] else self.outer)

    def narrow(self, b: int) -> None:
        """Keep the first b entries; the outer bound covers the others."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.low[:, b])
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def settle(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Give every row its nearest entry; for each unsettled row, how many entries were open (b + 1: all)."""
        b = self.near.shape[1]
        bound = np.concatenate([self.low, self.outer[:, None]], axis=1)
        rows = np.flatnonzero(self.high >= bound[:, 0])
        own = distances(x[rows], book[self.own[rows]][:, None])[:, 0]
        self.high[rows] = up(np.sqrt(own.astype(np.float64)))
        still = self.high[rows] >= bound[rows, 0]          # the exact distance may have settled it
        rows, own = rows[still], own[still]
        needed = (self.high[rows, None] >= bound[rows]).sum(1)   # bounds ascend: the first `needed` are open
        for m in range(1, b + 1):
            at, d0 = rows[needed == m], own[needed == m]
            if len(at):
                open_ = np.concatenate([self.own[at][:, None], self.near[at, :m]], axis=1)
                d = np.concatenate([d0[:, None], distances(x[at], book[self.near[at, :m]])], axis=1)
                order = np.lexsort((open_, d), axis=1)     # by distance, then entry
                open_, root = np.take_along_axis(open_, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                self.own[at], self.high[at] = open_[:, 0], up(root[:, 0])
                self.near[at, :m] = open_[:, 1:]
                self.low[at, :m] = np.minimum(down(root[:, 1:]), bound[at, m][:, None])
        self.search(x, book, rows[needed == b + 1])
        return needed


def lists(array: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A 2-D array as a column of lists."""
    offsets = np.arange(len(array) + 1, dtype=np.int32) * array.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(array).reshape(-1), kind))


def array_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


ROW = ("vec_id", "label", "x", "own", "high", "near", "low", "outer")
TOTAL = ("part", "entry", "n", "sums", "needed")
TYPES = {
    "x": ("array<int>", pa.list_(pa.int32())), "own": ("array<tinyint>", pa.list_(pa.int8())), "high": ("array<float>", pa.list_(pa.float32())),
    "near": ("array<tinyint>", pa.list_(pa.int8())), "low": ("array<float>", pa.list_(pa.float32())), "outer": ("array<float>", pa.list_(pa.float32())),
    "part": ("int", pa.int32()), "entry": ("int", pa.int32()), "n": ("bigint", pa.int64()), "sums": ("array<bigint>", pa.list_(pa.int64())),
    "needed": ("array<bigint>", pa.list_(pa.int64())),
}


def _batch(columns: dict, rows: int, kept: dict) -> pa.RecordBatch:
    out = [columns[c] if c in columns else pa.nulls(rows, kept[c] if c in kept else TYPES[c][1]) for c in ROW + TOTAL]
    return pa.RecordBatch.from_arrays(out, names=list(ROW + TOTAL))


def _round(books: np.ndarray, moved: np.ndarray | None, b: int, scale: int, parts: int):
    """One pass: rows with new codes and bounds, then the sums of the task.

    books (parts, entries, part length); moved (parts, entries) is None in the first round,
    which reads plain vectors.
    """
    def run(batches):
        k, width = books.shape[1:]
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        needed, kept, seen = np.zeros(b + 2, np.int64), {}, False
        for batch in batches:
            rows, seen = batch.num_rows, True
            kept = {c: batch.column(c).type for c in ("vec_id", "label")}
            if not rows:
                continue
            if moved is None:
                x = integers(array_of(batch.column("embedding"), rows), scale).reshape(rows, parts, width)
            else:
                x = array_of(batch.column("x"), rows).astype(np.int64).reshape(rows, parts, width)
                had = {c: array_of(batch.column(c), rows) for c in ("own", "high", "near", "low", "outer")}
                near, low = had["near"].astype(np.uint8).reshape(rows, parts, -1), had["low"].reshape(rows, parts, -1)
            states = []
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if moved is None:
                    state = Bounds.first(part, books[p], b)
                else:
                    state = Bounds(had["own"][:, p].astype(np.uint8), had["high"][:, p].copy(), near[:, p].copy(), low[:, p].copy(), had["outer"][:, p].copy())
                    state.move(moved[p])
                    state.narrow(b)
                    needed += np.bincount(state.settle(part, books[p]), minlength=b + 2)
                n[p] += np.bincount(state.own, minlength=k)
                for e in np.unique(state.own):
                    sums[p, e] += part[state.own == e].sum(0)
                states.append(state)
            of = lambda name: np.stack([getattr(s, name) for s in states], axis=1).reshape(rows, -1)
            yield _batch({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": lists(x.reshape(rows, -1).astype(np.int32), pa.int32()),
                "own": lists(of("own").astype(np.int8), pa.int8()), "high": lists(of("high"), pa.float32()),
                "near": lists(of("near").astype(np.int8), pa.int8()), "low": lists(of("low"), pa.float32()), "outer": lists(of("outer"), pa.float32()),
            }, rows, kept)
        if seen:
            p, e = np.nonzero(n)
            yield _batch({
                "part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[p, e]), "sums": lists(sums[p, e], pa.int64()),
                "needed": lists(np.where(np.arange(len(p))[:, None] == 0, needed[None], 0), pa.int64()),
            }, len(p), kept)
    return run


def _exact(books: np.ndarray, parts: int):
    """The code as hex digits and the summed squared distances of each row."""
    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = array_of(batch.column("x"), rows).astype(np.int64).reshape(rows, parts, -1)
            own = array_of(batch.column("own"), rows).astype(np.uint8)
            error = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in own], pa.string()),
                                              pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def root_above(squares: int) -> float:
    """A square root that is not below the true one."""
    return math.nextafter(math.sqrt(squares), math.inf) if squares else 0.0


def replaced(books: np.ndarray, totals: list) -> np.ndarray:
    """Every entry as the floored mean of its parts; unused entries stay."""
    new = books.copy()
    for r in totals:
        new[r["part"], r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return new


def next_width(needed: np.ndarray, b: int, entries: int) -> int:
    """The least b that holds the open entries of nearly all unsettled parts, an eighth of the entries at least."""
    if not needed.sum():
        return max(1, min(b, entries // 8))
    holds = np.cumsum(needed[: b + 1]) / needed.sum()
    fits = np.flatnonzero(holds >= COVERED)
    return max(1, min(b, max(int(fits[0]) if len(fits) else b, entries // 8)))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256.

    vectors: vec_id, label, embedding; other columns are not read.  Rows whose vector is NULL or
    empty, or holds a NULL or non-finite component, are left out.  Components become
    floor(scale * x).  All vectors have one dimension, a multiple of `parts`; it is that of the
    smallest vec_id whose dimension is such a multiple, and vectors of another are left out too.
    Codebooks start as the parts of the `entries` (at most 128) smallest vec_ids, rows of one
    vec_id in the order of their vectors, NULL ids last; with fewer vectors they are as much
    shorter.  Then `rounds` rounds assign (squared distance, ties to the lower index) and replace
    each entry by the floored mean of its parts; a last assignment follows.  `code` has two hex
    digits per part, `error` sums the squared distances, `label_error` the errors of equal labels
    (NULL labels are equal).  Repeated rows are vectors of their own.  Components so large that
    a squared distance overflows a long are an error.
    """
    if not 1 <= entries <= 128:
        raise ValueError("entries must be between 1 and 128")
    spark = vectors.sparkSession
    src = vectors.where(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    src = src.where(F.size("embedding") % parts == 0)
    order = F.col("vec_id").asc_nulls_last(), F.col("embedding")
    lead = src.orderBy(*order).limit(1).select(F.size("embedding").alias("dim")).first()
    if lead is None:
        return src.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                          F.lit("").alias("codebooks_sha256"))
    dim = lead["dim"]
    src = src.where(F.size("embedding") == dim)
    seeds = np.array([r["embedding"] for r in src.orderBy(*order).limit(entries).select("embedding").collect()])
    books = integers(seeds, scale).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()

    kinds = {c: src.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = ", ".join(f"{c} {kinds.get(c) or TYPES[c][0]}" for c in ROW + TOTAL)
    k = books.shape[1]
    b = min(max(1, k // 4), k - 1)
    state, moved = None, None
    for at in range(rounds + 1):
        before = state
        state = stored((src if at == 0 else before.where("part IS NULL").select(*ROW)).mapInArrow(_round(books, moved, b, scale, parts), schema), f"codes{at}")
        if before is not None:
            drop_stored(before)
        if at == rounds:
            break
        # One row per part, entry and component: as small as the codebooks.
        sums = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        totals = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("total")).collect()
        new = replaced(books, totals)
        steps = ((new - books) ** 2).sum(2)
        moved = np.array([[root_above(int(s)) for s in row] for row in steps])
        if at:
            widths = state.where("part IS NOT NULL").select(F.posexplode("needed").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
            needed = np.zeros(b + 2, np.int64)
            for r in widths:
                needed[r["at"]] = r["n"]
            b = next_width(needed, b, k) if k > 1 else 0
        books = new
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    coded = stored(state.where("part IS NULL").select("vec_id", "label", "x", "own").mapInArrow(
        _exact(books, parts), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "coded")
    drop_stored(state)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for DuckDB: every round compares every part with every entry."""
    assign = """a{0} AS MATERIALIZED (SELECT id, p, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT v.id, v.p, c.e, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
  FROM v JOIN c{0} c USING (p)) GROUP BY id, p)"""
    move = """s{0} AS (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT v.p, a.m.e AS e, unnest(range(1, len(v.x) + 1)) AS i, unnest(v.x) AS y FROM v JOIN a{0} a USING (id, p)) GROUP BY p, e, i),
c{1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(any_value(f.x), any_value(c.x)) AS x FROM c{0} c LEFT JOIN (
  SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM s{0} GROUP BY p, e) f USING (p, e) GROUP BY c.p, c.e)"""
    steps = [text.format(r, r + 1) for r in range(rounds) for text in (assign, move)] + [assign.format(rounds)]
    return f"""
WITH u AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM u, (SELECT unnest(range({parts})) AS p)),
c0 AS (SELECT p, id - 1 AS e, x FROM v WHERE id <= {entries}),
{("," + chr(10)).join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT u.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY u.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM u JOIN r USING (id), h
"""
