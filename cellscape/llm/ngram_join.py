"""Operator 5: exact Jaccard join of word-shingle sets by PartEnum signatures.

Sizes fall into bands, and a set takes part in the bands that a partner may be in.  Within
a band two similar sets differ in at most K elements.  The domain of shingles is dealt into
partitions, each into three cells; with K // 2 + 1 partitions, one holds at most one of the
differences, so two of its cells agree, and every pair of cells of every partition is sent
out as one signature.  Similar sets are sure to share one.  A part that is empty on both sides also agrees and says nothing: it is left
out, `slack` more partitions make up for it, and a set with more empty parts than that goes
on to another dealing of the domain.

The sets of a signature are first held against each other by counts of their shingles in
cells, so many that a cell holds four at most on average: the distance of the counts is never
above the number of differences, so what it rules out is no link, and for unlike sets it is
far above, however long they are.  What is left forms clusters, in which blocks of sets are compared
with blocks, exactly.  Both steps give back edges of spanning forests, not pairs.  Nothing
is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellscape.llm import tokens
from cellscape.operators.graph import connected_components
from cellscape.session import drop_stored, stored

BLOCK_SETS = 400           # sets of a block, on average
BLOCK_SHINGLES = 1 << 20   # and shingles
SCHEMES = 40               # dealings of the domain; the last one keeps empty parts
FILTER_BITS = 1 << 24
COUNT_CELLS = 128          # cells of the counts, at least
COUNTED = 4                # shingles of a cell, at most on average
MATRIX = 1 << 22           # counts that are compared at once
BUCKET = 512               # sets of a signature that are held against so many others at once

HEADS = "doc_id long, n_shingles long, h1 long, h2 long, counts binary"


def shingles(raw, offsets, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row as sorted hashes, flat, with offsets.

    Fewer words than n make one shingle of the whole row, no words none.
    """
    starts, ends, first = tokens.word_bounds(raw, offsets)
    words = tokens.word_hashes(raw, starts, ends)
    count = np.diff(first)
    total = len(words)
    rolled = np.zeros(total, dtype=np.uint64)
    for k in range(n):  # the last words weigh first, so that order matters
        shifted = np.zeros(total, dtype=np.uint64)
        shifted[: max(0, total - k)] = words[k:]
        rolled = tokens.mix(rolled * np.uint64(3) + shifted)
    sets = []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if count[i] >= n:
            x = np.sort(rolled[a : b - n + 1])
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif count[i]:
            x = np.array([count[i]], dtype=np.uint64)
            for w in words[a:b]:
                x = tokens.mix(x * np.uint64(5) + w)
        else:
            x = np.empty(0, dtype=np.uint64)
        sets.append(x)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower ends of the size bands up to one beyond the largest; a band ends at low / t**2."""
    lows = [1]
    while lows[-1] <= largest:
        low = lows[-1]
        lows.append(max(low, low * den * den // (num * num)) + 1)
    lows.append(max(lows[-1], lows[-1] * den * den // (num * num)) + 1)
    return np.array(lows, dtype=np.int64)


def sums(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of the values of each cell."""
    low = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(cell, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
    return (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)


def slack_of(least: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Partitions beyond the least number that make up for those with two empty cells.

    As many as the smallest sets of the band are likely to have, with a quarter more.
    """
    out = np.maximum(1, -(-least // 2))
    for percent in (30, 20, 15, 10):
        more = np.maximum(1, -(-least * percent // 100))
        bare = 3 * np.exp(-2 * smallest / (3 * (least + more)))
        out = np.where(1.25 * bare * (least + more) <= more, more, out)
    return out


def signatures(flat: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every signature of every set.

    A set has the signatures of its own band, for partners there, and those of either end of
    the band within reach, for partners beyond it: across an end B, two sets differ in fewer
    elements than two of the largest sets of a band.
    """
    size = np.diff(offsets)
    lows = bands(int(size.max(initial=1)), num, den)
    own = np.searchsorted(lows, size, side="right") - 1
    rows_out, sigs_out = [], []
    full, upper = size > 0, lows[np.minimum(own + 1, len(lows) - 1)]
    below, above = np.flatnonzero(full & (size * den // num >= upper)), np.flatnonzero(full & (size <= (lows[own] - 1) * den // num))
    at_end = np.concatenate([own[below] + 1, own[above]])
    for rows, band, across in ((np.flatnonzero(full), own[full], 0), (np.concatenate([below, above]), at_end, 1)):
        high, low = lows[band + 1 - across] - 1, lows[band]
        differ = (high + (high * den // num if across else high)) * (den - num) // (den + num)      # K
        rows, band, high, low, differ = (x[differ > 0] for x in (rows, band, high, low, differ))  # else only equal sets
        least = differ // 2 + 1
        slack = slack_of(least, low * num // den if across else low)
        parts = least + slack
        for scheme in range(SCHEMES):
            if not len(rows):
                break
            n = size[rows]
            pick = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seed = tokens.mix((band.astype(np.uint64) << np.uint64(9)) + np.uint64(256 * across + scheme))
            z = tokens.mix(flat[pick] + np.repeat(seed, n))
            width = parts * 3
            base = np.concatenate([[0], np.cumsum(width)])
            cell = ((z >> np.uint64(33)) % np.repeat(width.astype(np.uint64), n)).astype(np.int64) + np.repeat(base[:-1], n)
            total, held = sums(cell, tokens.mix(z), base[-1]), np.bincount(cell, minlength=base[-1])
            empty = np.zeros(len(rows), dtype=np.int64)
            owner = np.repeat(np.arange(len(rows)), parts)
            place = np.arange(parts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
            start = base[:-1][owner] + place * 3
            bare = np.zeros(len(owner), dtype=bool)
            for code, a, b in ((1, 0, 1), (2, 0, 2), (3, 1, 2)):
                at = np.arange(len(owner))
                first, second = total[start[at] + a], total[start[at] + b]
                filled = (held[start[at] + a] + held[start[at] + b]) > 0
                bare[at[~filled]] = True
                if scheme < SCHEMES - 1:
                    at, first, second = at[filled], first[filled], second[filled]
                key = tokens.mix(seed[owner[at]] + (place[at].astype(np.uint64) << np.uint64(2)) + np.uint64(code))
                rows_out.append(rows[owner[at]])
                sigs_out.append(tokens.mix(tokens.mix(key + first) + second * np.uint64(3)))
            np.add.at(empty, owner[bare], 1)
            more = empty > slack
            rows, band, slack, parts = (x[more] for x in (rows, band, slack, parts))
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(sigs_out)


def digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that name the set of each row."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.uint64)
    return (tokens.mix(sums(owner, tokens.mix(flat), n) + size),
            tokens.mix(sums(owner, tokens.mix(flat ^ tokens.BASE), n) + size * np.uint64(7)))


def counts(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Of each set, how many shingles (255 at most) fall into each cell: one byte per cell.

    The number of cells is a power of two, so that a longer row of counts folds into a shorter.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    cells = np.full(n, COUNT_CELLS, dtype=np.int64)
    while (more := cells * COUNTED < size).any():
        cells[more] *= 2
    ends = np.concatenate([[0], np.cumsum(cells)])
    at = (tokens.mix(flat + tokens.BASE) >> np.uint64(24)).astype(np.int64) & np.repeat(cells - 1, size)
    held = np.bincount(np.repeat(ends[:-1], size) + at, minlength=ends[-1])
    data = np.minimum(held, 255).astype(np.uint8).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def list_array(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].view(np.int64)))


def _heads(n: int):
    def run(parts):
        for batch in parts:
            table = pa.Table.from_batches([batch])
            ids = table.column("doc_id").combine_chunks()
            for at, piece in tokens.batches(table.column("text").combine_chunks()):
                flat, ends = shingles(*tokens.flat_bytes(piece), n)
                h1, h2 = digests(flat, ends)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(piece)), pa.array(np.diff(ends)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    counts(flat, ends)], names=["doc_id", "n_shingles", "h1", "h2", "counts"])
    return run


def _signed(n: int, num: int, den: int):
    def run(parts):
        for batch in parts:
            text = pa.Table.from_batches([batch]).column("text").combine_chunks()
            for at, piece in tokens.batches(text):
                flat, ends = shingles(*tokens.flat_bytes(piece), n)
                h1, _ = digests(flat, ends)
                rows, sigs = signatures(flat, ends, num, den)
                # Copies in the batch say the same, so one of them speaks.  Every other set goes on
                # under its own signature: no set of a bucket can stand for another, as both may be
                # too far apart and still have a third that links with one of them.
                name = h1[rows]
                order = np.lexsort((name, sigs))
                name, sigs, rows = name[order], sigs[order], rows[order]
                if len(sigs):
                    new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (name[1:] != name[:-1])])
                    rows, sigs = rows[new], sigs[new]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), list_array(rows, sigs, len(piece))], names=["h1", "sigs"])
    return run


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A fixed-size filter of the ids: what it lets through still has to be joined."""
    words = ids.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("slot")).selectExpr(
        "slot div 32 AS word", "shiftleft(1L, int(slot % 32)) AS bit"
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _sets(n: int, wanted):
    def run(parts):
        bits = wanted.value
        for batch in parts:
            slot = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1
            if not keep.any():
                continue
            table = pa.Table.from_batches([batch]).filter(pa.array(keep.astype(bool)))
            text, ids = table.column("text").combine_chunks(), table.column("doc_id").combine_chunks()
            for at, piece in tokens.batches(text):
                raw, offsets = tokens.flat_bytes(piece)
                flat, ends = shingles(raw, offsets, n)
                h1, h2 = digests(flat, ends)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(piece)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64))),
                ], names=["doc_id", "h1", "h2", "shingles"])
    return run


def shared(left: pa.ChunkedArray, right: pa.ChunkedArray, step: int = 2048) -> np.ndarray:
    """Intersection sizes of every set on the left with every set on the right."""
    def flat(column):
        lists = column.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(lists.offsets.to_numpy())
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), n
    a, a_row, a_n = flat(left)
    b, b_row, b_n = flat(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(a_n), len(b_n)), dtype=np.float32)
    sides = []
    for values, rows in ((a, a_row), (b, b_row)):
        at = np.searchsorted(both, values)
        hit = (at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == values) if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(both), step):
        dense = []
        for (at, rows), n in zip(sides, (len(a_n), len(b_n))):
            s, e = np.searchsorted(at, (low, low + step))
            m = np.zeros((n, step), dtype=np.float32)
            m[rows[s:e], at[s:e] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the matrix links, at most one for each row and column."""
    a, b = np.arange(len(left)), np.full(len(right), len(left) + len(right))
    big = len(left) + len(right)
    while True:
        nb = np.minimum(b, np.where(linked, a[:, None], big).min(axis=0, initial=big))
        na = np.minimum(a, np.where(linked, nb[None, :], big).min(axis=1, initial=big))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    at = np.flatnonzero(b < big)
    up = np.flatnonzero(a != np.arange(len(left)))
    return np.concatenate([left[up], right[at]]), np.concatenate([left[a[up]], left[b[at]]])


def _possible(num: int, den: int):
    """Of each group of rows (bucket, i, j) with sets' counts: edges between sets that may link."""
    def within(h1, block, size, held):
        i, j = block.min(), block.max()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = np.empty((len(left), len(right)), dtype=bool)
        for k, a in enumerate(left):
            apart = np.abs(held[right] - held[a]).sum(axis=1, dtype=np.int64)
            linked[k] = apart * (den + num) <= (den - num) * (size[right] + size[a])
        return forest(linked, h1[left], h1[right])

    def run(parts):
        rest = None
        for batch in parts:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = [rest.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if not len(cut):
                continue
            yield from edges(rest.slice(0, int(cut[-1])), cut)
            rest = rest.slice(int(cut[-1])).combine_chunks()
        if rest is not None and len(rest):
            keys = [rest.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            yield from edges(rest, np.append(cut, len(rest)))

    def edges(table, cut):
        h1, block, size = (table.column(c).to_numpy() for c in ("h1", "block", "n_shingles"))
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("counts").chunks])
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1]
        data, length = np.frombuffer(column.buffers()[2], dtype=np.uint8), np.diff(ends)

        def folded(rows, cells):
            out = np.empty((len(rows), cells), dtype=np.int16)
            for long in np.unique(length[rows]):
                own = np.flatnonzero(length[rows] == long)
                out[own] = data[ends[rows[own], None] + np.arange(long)].reshape(len(own), long // cells, cells).sum(1, dtype=np.int16)
            return out

        starts = np.concatenate([[0], cut[:-1]])
        least = np.minimum.reduceat(length, starts)     # cells that all sets of a group can be folded to
        u, v = [], []
        for cells in np.unique(least):
            two = starts[(cut - starts == 2) & (least == cells)]
            step = max(1, MATRIX // int(cells))
            for a in (two[k : k + step] for k in range(0, len(two), step)):
                apart = np.abs(folded(a, cells) - folded(a + 1, cells)).sum(axis=1, dtype=np.int64)
                ok = a[apart * (den + num) <= (den - num) * (size[a] + size[a + 1])]
                u.append(h1[ok])
                v.append(h1[ok + 1])
        for a, b, cells in zip(starts, cut, least):
            if b - a > 2:
                x, y = within(h1[a:b], block[a:b], size[a:b], folded(np.arange(a, b), cells))
                u.append(x)
                v.append(y)
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
        yield pa.RecordBatch.from_arrays([pa.array(u[u != v], pa.int64()), pa.array(v[u != v], pa.int64())], names=["u", "v"])
    return run


def _compare(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = table.column("block").to_numpy()
        left, right = table.filter(pa.array(block == i)), table.filter(pa.array(block == j))
        edges = [np.empty(0, np.int64)] * 2
        if len(left) and len(right):
            common = shared(left.column("shingles"), right.column("shingles")).astype(np.int64)
            n, m = left.column("n_shingles").to_numpy(), right.column("n_shingles").to_numpy()
            linked = den * common >= num * (n[:, None] + m[None, :] - common)
            edges = forest(linked, left.column("doc_id").to_numpy(), right.column("doc_id").to_numpy())
        keep = edges[0] != edges[1]
        return pa.table({"u": pa.array(edges[0][keep], pa.int64()), "v": pa.array(edges[1][keep], pa.int64())})
    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    docs: doc_id, text; other columns are not read.  Two documents link when their sets of
    distinct n-word shingles (fewer words: the whole sequence) have a Jaccard similarity of
    num / den or more.  NULL, empty and blank texts have an empty set and link with nothing.
    Rows that repeat a doc_id are one node of the graph, each with its own set; a row
    without doc_id is no node and its component is NULL.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    headed = stored(texts.mapInArrow(_heads(n), HEADS), "heads")
    heads = headed.select("doc_id", "n_shingles", "h1", "h2")
    classes = stored(heads.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "classes")

    # The sets of every signature that more than one has; signatures of the same sets are one bucket.
    signed = texts.select("text").mapInArrow(_signed(n, num, den), "h1 long, sigs array<long>")
    sigs = signed.select("h1", F.explode("sigs").alias("sig"))
    by = Window.partitionBy("sig")
    shared_by = sigs.select("sig", "h1", F.min("h1").over(by).alias("low"), F.max("h1").over(by).alias("high")).where("low < high")
    shared_by = shared_by.select("sig", "h1").dropDuplicates()
    buckets = shared_by.select("h1", F.count(F.lit(1)).over(by).alias("m"), F.bit_xor(F.xxhash64("h1")).over(by).alias("bucket"))
    buckets = stored(buckets.distinct(), "buckets")
    held = headed.where("n_shingles > 0").groupBy("h1").agg(F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"))
    held = stored(held.join(buckets.select("h1").distinct(), "h1", "left_semi"), "counts")
    dealt = buckets.withColumn("blocks", F.ceil(F.col("m") / BUCKET)).withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("bucket", "m").alias("bucket"), "h1", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(held, "h1").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    near = dealt.mapInArrow(_possible(num, den), "u long, v long").distinct()
    near = stored(near, "near")
    clusters = connected_components(near)

    nodes = stored(classes.join(clusters.withColumnRenamed("node", "h1"), "h1").select(
        "rep", "h1", "h2", "n_shingles", F.col("component").alias("cluster")), "nodes")
    sizes = stored(nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("weight"))
                   .where("sets > 1").select("cluster", F.greatest(
                       F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).alias("blocks")), "sizes")
    placed = stored(nodes.join(sizes, "cluster").select(
        F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles", "cluster", "blocks",
        F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).alias("block")), "placed")

    drop_stored(buckets, held, near, clusters, nodes, sizes)
    wanted = spark.sparkContext.broadcast(bitmap(placed, "doc_id"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
    found = texts.where("doc_id IS NOT NULL").select("doc_id", "text", slot).mapInArrow(
        _sets(n, wanted), "doc_id long, h1 long, h2 long, shingles array<long>").where("size(shingles) > 0")
    pairs = placed.join(found, ["doc_id", "h1", "h2"]).select(
        "cluster", "block", "doc_id", "shingles", F.size("shingles").cast("long").alias("n_shingles"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
             "block", "doc_id", "n_shingles", "shingles")
    links = pairs.groupBy("cluster", "i", "j").applyInArrow(_compare(num, den), "u long, v long").distinct()

    # Rows that repeat a doc_id tie their classes together.
    marked = heads.where("n_shingles > 0 AND doc_id IS NOT NULL")
    again = stored(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "again")
    ties = marked.join(again, "doc_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = stored(links, "links")
    tops = connected_components(links.unionByName(ties))
    lead = stored(classes.select("h1", "h2", "rep").join(tops.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component_id")), "lead")
    drop_stored(links, placed, again, tops, classes)
    joined = heads.join(lead, ["h1", "h2"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(
        F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near-duplicates: of every component the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays (the smallest text).  Rows without doc_id stay.
    """
    parts = stored(jaccard_components(docs, n, num, den), "components")
    gone = stored(parts.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    twice = stored(parts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    again = docs["doc_id"] == twice["doc_id"]
    first = kept.join(twice, again, "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return kept.join(twice, again, "left_anti").unionByName(first)
