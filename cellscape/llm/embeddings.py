"""Operator 10: near-duplicate vectors by product quantisation, without losing a pair.

Vectors are normalised; a coarse quantiser deals them to inverted lists, and a list stores
each vector's residual as codes of subspaces, with the length of what the codes lose.  A
query probes every list whose cell comes within reach of it, estimates distances from a
table of its distances to the codewords (the query itself is not quantised), keeps what the
lost length cannot rule out, and decides those by the exact cosine in double precision.
Both bounds are safe, so recall does not depend on how well the quantisers fit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm import opened, shipped, tokens
from cellscape.llm.ngram_join import forest
from cellscape.operators.graph import connected_components
from cellscape.session import stored

SAMPLE = 20_000          # vectors that the quantisers are fitted on, at most
LISTS = (4, 4096)        # coarse cells, at least and at most
LIST_ROWS = 512          # rows of a list of one label that their number aims at
SUBSPACES = 8
CODEWORDS = 256
BLOCK = 1024             # rows of a list, or queries, that are compared at once

ROWS = "vec_id long, space string, h1 long, h2 long, embedding array<double>"


def _read(parts):
    """Mark rows that take part (space: label and dimension) and name equal vectors."""
    for batch in parts:
        ids, labels, vectors = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        space, first, second, kept = [], [], [], []
        for label, v in zip(labels, vectors):
            x = None if v is None or label is None or None in v else np.array(v, dtype=np.float64) + 0.0
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                space.append(None), first.append(0), second.append(0), kept.append(None)
                continue
            at = np.arange(len(x), dtype=np.uint64)
            bits = tokens.mix(x.view(np.uint64) ^ tokens.mix(at + np.uint64(1)))
            space.append(f"{label}|{len(x)}"), kept.append(x)
            first.append(int(bits.sum(dtype=np.uint64).view(np.int64)))
            second.append(int(tokens.mix(bits ^ tokens.BASE).sum(dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(space, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                                          pa.array(kept, pa.list_(pa.float64()))], names=["vec_id", "space", "h1", "h2", "embedding"])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; an empty cell keeps its centre."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Quantisers:
    """Coarse centres and codebooks for one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = centres(sample, lists)
        near = squared(sample, self.coarse).argmin(1)
        rest = sample - self.coarse[near]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [centres(rest[:, a:b], CODEWORDS, 5) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encoded(self, x: np.ndarray):
        """Cell, codes and lost length of unit vectors."""
        cell = squared(x, self.coarse).argmin(1)
        rest = x - self.coarse[cell]
        codes = np.stack([squared(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1)
        spelled = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(((rest - spelled) ** 2).sum(1))

    def reached(self, x: np.ndarray, cell: np.ndarray, reach: float) -> np.ndarray:
        """Cells in which a vector within `reach` of x may lie: the plane between them is as near."""
        d = squared(x, self.coarse)
        apart = np.sqrt(squared(self.coarse, self.coarse))[cell]
        own = d[np.arange(len(x)), cell][:, None]
        return (d - own) <= 2 * apart * reach + 1e-9

    def table(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the queries to the coded vectors of a list, by table look-up."""
        rest = x - self.coarse[cell]
        out = np.zeros((len(x), len(codes)))
        for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            out += np.take(squared(rest[:, a:b], self.books[i]), codes[:, i], axis=1)
        return out


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(column), -1)


def _dealt(shared, reach: float):
    """For every vector its own list, and the later lists that it has to ask as a query."""
    def run(parts):
        quantisers = opened(shared)
        for batch in parts:
            table = pa.Table.from_batches([batch])
            spaces = np.array(table.column("space").to_pylist(), dtype=object)
            for space in sorted(set(spaces)):
                part = table.filter(pa.array(spaces == space))
                x = _vectors(part.column("embedding"))
                q = quantisers[x.shape[1]]
                cell, codes, lost = q.encoded(x / np.sqrt((x * x).sum(1))[:, None])
                ask = q.reached(x / np.sqrt((x * x).sum(1))[:, None], cell, reach) & (np.arange(len(q.coarse))[None] >= cell[:, None])
                yield pa.RecordBatch.from_arrays([
                    part.column("rep").combine_chunks(), part.column("space").combine_chunks(), part.column("m").combine_chunks(),
                    part.column("embedding").combine_chunks(), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(lost), pa.array([np.flatnonzero(r).astype(np.int32) for r in ask], pa.list_(pa.int32())),
                ], names=["rep", "space", "m", "embedding", "cell", "codes", "lost", "asks"])
    return run


DEALT = "rep long, space string, m long, embedding array<double>, cell int, codes binary, lost double, asks array<int>"


def _linked(shared, least: float, reach: float):
    """Compare the queries of a block with the list rows of a block: links counted, forest edges."""
    held = {}

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("list")[0].as_py()
        asking = table.column("asking").to_numpy(zero_copy_only=False)
        left, right = table.filter(pa.array(asking)), table.filter(pa.array(~asking))
        u, v, n = [], [], []
        if len(left) and len(right):
            x, y = _vectors(left.column("embedding")), _vectors(right.column("embedding"))
            if not held:
                held.update(opened(shared))     # once a task
            q = held[x.shape[1]]
            xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), dtype=np.uint8).reshape(len(right), -1)
            near = q.table(x / xn[:, None], cell, codes) <= (reach + right.column("lost").to_numpy()[None] + 1e-6) ** 2
            a, b = left.column("rep").to_numpy(), right.column("rep").to_numpy()
            near &= a[:, None] != b[None]
            rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            sub = near[np.ix_(rows, cols)] & ((x[rows] @ y[cols].T) / (xn[rows][:, None] * yn[cols][None]) >= least)
            ma, mb = left.column("m").to_numpy()[rows], right.column("m").to_numpy()[cols]
            other = left.column("cell").to_numpy()[rows] != cell   # such a pair is seen from this side alone
            gained = sub @ mb.astype(np.int64)
            given = (sub & other[:, None]).T @ ma.astype(np.int64)
            for ids, count in ((a[rows], gained), (b[cols], given)):
                u.append(ids[count > 0]), v.append(ids[count > 0]), n.append(count[count > 0])
            p, r = forest(sub, a[rows], b[cols])
            u.append(p), v.append(r), n.append(np.zeros(len(p), dtype=np.int64))
        join = lambda xs: pa.array(np.concatenate(xs) if xs else [], pa.int64())
        return pa.table({"u": join(u), "v": join(v), "n": join(n)})
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    vectors: vec_id, label, embedding; other columns are not read.  Two vectors link when
    their labels are equal and not NULL, they have the same dimension, and their cosine in
    double precision is `least` or more.  A vector that is NULL, empty or zero, or holds a
    NULL or non-finite component, links with nothing and is its own component.  component_id
    is the smallest vec_id reachable by links, itself included.  Equal vectors are compared
    once and counted as often as they occur; rows that repeat a vec_id are vectors of their
    own; a row without vec_id is compared but gets no component.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
                  .mapInArrow(_read, ROWS), "vectors")
    classes = stored(rows.where("space IS NOT NULL").groupBy("space", "h1", "h2").agg(
        F.coalesce(F.min("vec_id"), F.xxhash64(F.first("space"), F.first("h1"), F.first("h2"))).alias("rep"),
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low")), "classes")
    reps = rows.join(classes, ["space", "h1", "h2"]).where("vec_id <=> low").dropDuplicates(["space", "h1", "h2"]).select("rep", "space", "m", "embedding")
    reps = stored(reps, "reps")

    reach = math.sqrt(2 - 2 * least) + 1e-9
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("space").alias("spaces")).first()
    lists = min(LISTS[1], max(LISTS[0], -(-size["n"] // (LIST_ROWS * max(1, size["spaces"])))))
    fitted = {}
    for dim in sorted({len(v) for v in sample} | {r["dim"] for r in reps.select(F.size("embedding").alias("dim")).distinct().collect()}):
        own = np.array([v for v in sample if len(v) == dim], dtype=np.float64).reshape(-1, dim)
        own = own if len(own) else np.ones((1, dim))   # a dimension too rare for the sample: one cell
        fitted[dim] = Quantisers(own / np.sqrt((own * own).sum(1))[:, None], lists)
    shared = shipped(spark, fitted)

    dealt = stored(reps.mapInArrow(_dealt(shared, reach), DEALT), "dealt")
    held = dealt.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("rows"))
    asked = dealt.select("space", F.explode("asks").alias("list")).groupBy("space", "list").agg(F.count(F.lit(1)).alias("queries"))
    blocks = stored(held.withColumnRenamed("cell", "list").join(asked, ["space", "list"]).select(
        "space", "list", F.ceil(F.col("rows") / BLOCK).alias("ways"), F.ceil(F.col("queries") / BLOCK).alias("turns")), "blocks")
    slot = F.xxhash64("rep")
    queries = dealt.select("rep", "space", "m", "embedding", "cell", F.explode("asks").alias("list")).join(blocks, ["space", "list"]).select(
        "space", "list", F.lit(True).alias("asking"), "rep", "m", "embedding", "cell", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("lost"),
        F.pmod(slot, F.col("turns")).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("way"))
    listed = dealt.withColumnRenamed("cell", "list").join(blocks, ["space", "list"]).select(
        "space", "list", F.lit(False).alias("asking"), "rep", "m", "embedding", F.col("list").alias("cell"), "codes", "lost",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.pmod(slot, F.col("ways")).alias("way"))
    found = stored(queries.unionByName(listed).groupBy("space", "list", "turn", "way").applyInArrow(
        _linked(shared, least, reach), "u long, v long, n long"), "links")

    links = stored(found.groupBy("u").agg(F.sum("n").alias("links")), "counts")
    tops = connected_components(found.where("u <> v").select("u", "v"))
    placed = stored(classes.join(tops.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    # A class without any vec_id goes by a hash; it joins others, but no component is named by it.
    named = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    lead = placed.join(links.withColumnRenamed("u", "rep"), "rep", "left").join(named, "component")
    lead = stored(lead.select("space", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "lead")
    out = rows.drop("embedding").join(lead, ["space", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
