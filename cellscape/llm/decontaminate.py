"""Operator 3: benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages.  TF-IDF vectors of all passages, over the terms
of the benchmark items, are sketched in one distributed pass; the sketch gives the leading
right singular vectors (a randomised SVD of the passages' Gram operator).  A second pass
projects every passage, finds items and passages of longer items by cosine, shorter items
also in windows of half the length, and decides each candidate by the longest common
subsequence of words with the item, and by its answer where that is not enough.
Both passes read each text whole and alone; no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm import opened, shipped, tokens
from cellscape.session import stored

HALF = 20              # a passage is two halves of so many words, and the next one starts at its second
SKETCH, RANK = 208, 200  # columns of the sketch, singular vectors that are kept
RARE = 2.7             # inverse document frequency of the terms that count
LEAST_TERMS = 16       # the rarest terms of an item count in any case
COSINE = 0.4           # of a candidate, between vectors scaled by the singular values
SHORT_SHARE = 0.6      # of the cosine that an exact copy of a short item reaches in a window; a candidate if below COSINE
SURE, LIKELY, ANSWER = 0.75, 0.6, 0.9
ITEM_BLOCK = 5_000     # items that are searched for at once; more are searched block by block
TERM_BLOCK = 4         # rows of the sketch that travel together: small, as many arrive in one batch
STEP = 8_000           # words that are projected at once


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, flat, and the first word of each row (n + 1)."""
    raw, offsets = tokens.flat_bytes(texts)
    starts, ends, first = tokens.word_bounds(raw, offsets, tokens.PUNCTUATED)
    return tokens.word_hashes(raw, starts, ends), first


class Items:
    """The benchmark items of a block: their words and answers."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        flat, first = words_of(pa.array([r[1] for r in rows], pa.string()))
        self.words = [flat[a:b] for a, b in zip(first[:-1], first[1:])]
        flat, first = words_of(pa.array([r[2] for r in rows], pa.string()))
        self.answers = [flat[a:b] for a, b in zip(first[:-1], first[1:])]
        self.terms = np.unique(np.concatenate(self.words)) if self.words else np.empty(0, np.uint64)
        self.weight = np.ones(len(self.terms))
        self.basis = np.zeros((len(self.terms), 1))
        self.slots = self.latent = self.matchers = None

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Index of each word among the terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(words), -1)
        if self.slots is None:  # most words are no terms: a table of low bits says so at once
            self.slots = np.zeros(1 << 20, dtype=bool)
            self.slots[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out = np.full(len(words), -1)
        may = np.flatnonzero(self.slots[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[may]), len(self.terms) - 1)
        hit = self.terms[at] == words[may]
        out[may[hit]] = at[hit]
        return out

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        idf = np.log((1 + documents) / (1 + frequency))
        counted = idf >= RARE
        for words in self.words:
            own = np.searchsorted(self.terms, np.unique(words))
            counted[own[np.argsort(-idf[own], kind="stable")[:LEAST_TERMS]]] = True
        self.weight = np.where(counted, np.maximum(idf, 0.05), 0.0)

    def project(self) -> None:
        parts = [(k, part) for k, w in enumerate(self.words) for part in [w] + item_passages(w)]
        self.owner = np.array([k for k, _ in parts], dtype=np.int64)
        sums = np.array([(self.weight[i, None] * self.basis[i]).sum(0) for i in (np.searchsorted(self.terms, part) for _, part in parts)])
        size = np.sqrt((sums * sums).sum(1)).reshape(-1, 1)
        self.latent = (sums / np.maximum(size, 1e-12)).astype(np.float32)
        self.matchers = [Matcher(w) for w in self.words]
        n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.short = np.flatnonzero((n[self.owner] > 0) & (n[self.owner] < HALF))   # one part each
        self.least_short = np.minimum(COSINE, SHORT_SHARE * np.sqrt(n[self.owner[self.short]] / HALF)).astype(np.float32)


def item_passages(words: np.ndarray) -> list[np.ndarray]:
    """An item longer than a passage in passages of its own, with the stride of the documents'."""
    return [words[i : i + 2 * HALF] for i in range(0, len(words) - HALF, HALF)] if len(words) > 2 * HALF else []


class Matcher:
    """Longest common subsequence with one sequence, a machine word for many cells."""

    def __init__(self, words: np.ndarray):
        self.n, self.places = len(words), {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> int:
        full = (1 << self.n) - 1
        row = full
        for w in words:
            here = self.places.get(w)
            if here is not None:
                u = row & here
                row = (row + u | row - u) & full
        return self.n - row.bit_count()


def halves(first: np.ndarray, size: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """For a flat run of words: the half that each word is in, and the first half of each row (n + 1)."""
    n = np.diff(first)
    count = -(-n // size)
    start = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(start[:-1], n) + place // size, start


def passages(start: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(first half, last half) of every passage; a row of one half is one passage."""
    last = np.zeros(total, dtype=bool)
    ends = start[1:][np.diff(start) > 0] - 1
    last[ends] = True
    single = np.zeros(total, dtype=bool)
    single[start[:-1][np.diff(start) == 1]] = True
    a = np.flatnonzero(~last | single)
    return a, np.where(single[a], a, a + 1)


def worded(a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages with a weighted term; all others are at right angles to everything."""
    has = sums.any(axis=1)
    keep = has[a] | has[b]
    return a[keep], b[keep]


def half_sums(items: Items, term: np.ndarray, half: np.ndarray, total: int, table: np.ndarray) -> np.ndarray:
    """Sum of the weighted table rows of the terms in each half.

    Halves in the order of their number of terms: the first terms of all of them are added at
    once, then the second ones of those that have one, and so on, each time a leading slice.
    """
    at = np.flatnonzero((term >= 0) & (items.weight[term] > 0))
    count = np.bincount(half[at], minlength=total)
    order = np.argsort(-count, kind="stable")
    place = np.empty(total, dtype=np.int64)
    place[order] = np.arange(total)
    nth = np.arange(len(at)) - (np.cumsum(count) - count)[half[at]]
    lined = np.lexsort((place[half[at]], nth))                # by number within the half, then by place
    terms, many = term[at][lined], np.bincount(nth, minlength=1)
    sums = np.zeros((total, table.shape[1]), dtype=np.float32)
    start = 0
    for n in many.tolist():
        for i in range(0, n, STEP):
            k = min(n, i + STEP)
            sums[i:k] += table[terms[start + i : start + k]]
        start += n
    return sums[place]


def _frequencies(shared):
    def run(parts):
        items = opened(shared)
        total, documents = np.zeros(len(items.terms), dtype=np.int64), 0
        for batch in parts:
            text = batch.column(0)
            for _, piece in tokens.batches(text):
                words, first = words_of(piece)
                term = items.lookup(words)
                row = np.repeat(np.arange(len(piece)), np.diff(first))
                pair = np.unique(row[term >= 0] * len(items.terms) + term[term >= 0]) if len(items.terms) else np.empty(0, np.int64)
                total += np.bincount(pair % max(1, len(items.terms)), minlength=len(items.terms))
                documents += len(piece)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], documents))], names=["term", "n"])
    return run


def _sketched(shared, omega_seed: int):
    def run(parts):
        items = opened(shared)
        omega = random_basis(len(items.terms), omega_seed)
        table = (items.weight[:, None] * omega).astype(np.float32)
        out = np.zeros((len(items.terms), omega.shape[1]))
        for batch in parts:
            for _, piece in tokens.batches(batch.column(0), 1 << 20):
                words, first = words_of(piece)
                term = items.lookup(words)
                half, start = halves(first)
                total = int(start[-1])
                if not total:
                    continue
                sums = half_sums(items, term, half, total, table)
                a, b = worded(*passages(start, total), sums)
                two = np.flatnonzero(a != b)
                rows = sums[a]
                rows[two] += sums[b[two]]
                each = np.zeros_like(sums)     # what the passages of a half add up to
                each[a] = rows
                each[b[two]] += rows[two]
                at = np.flatnonzero((term >= 0) & (items.weight[term] > 0))
                at = at[np.argsort(term[at], kind="stable")]
                for i in range(0, len(at), STEP):
                    part = at[i : i + STEP]
                    cut = np.flatnonzero(np.concatenate([[True], term[part][1:] != term[part][:-1]]))
                    out[term[part][cut]] += np.add.reduceat(each[half[part]], cut, axis=0)
        out *= items.weight[:, None]
        n = -(-len(items.terms) // TERM_BLOCK)
        rows = [out[i * TERM_BLOCK : (i + 1) * TERM_BLOCK] for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "rows"])
    return run


def _added(parts):
    """Sums of the parts of each block, as they stream by: one array for a block, whatever the number of parts."""
    total: dict[int, np.ndarray] = {}
    for batch in parts:
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(rows.as_buffer(), dtype=np.float64)
            if block in total:
                total[block] += part
            else:
                total[block] = part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "rows"])


def random_basis(n: int, seed: int) -> np.ndarray:
    columns = min(SKETCH, n)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, columns)))[0] if n else np.zeros((0, 1))


def singular_vectors(sketch: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Leading right singular vectors over their values, from G @ omega for the Gram matrix G.

    A Nystrom approximation.  Divided by the singular values, all directions count nearly
    alike, so that what a few items alone say is not drowned by what many passages share; half
    the middle value is added (as squares) to keep the least of them from being blown up.
    """
    shift = 1e-9 * max(np.linalg.norm(sketch), 1e-12)
    y = sketch + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-12 * max(values.max(initial=0), 1e-300)
    if not keep.any():
        return omega
    u, size, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    size = size[:RANK]
    return u[:, :RANK] / np.sqrt(size**2 + (size[len(size) // 2] / 2) ** 2)


def _found(shared):
    def run(parts):
        items = opened(shared)
        items.project()
        table = (items.weight[:, None] * items.basis).astype(np.float32)
        for batch in parts:
            for at, piece in tokens.batches(batch.column(1), 1 << 20):
                words, first = words_of(piece)
                best: dict[tuple[int, int], tuple] = {}

                def look(sums, start, size, latent, owner, least):
                    a, b = worded(*passages(start, len(sums)), sums)
                    rows, two = sums[a], np.flatnonzero(a != b)
                    rows[two] += sums[b[two]]
                    rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
                    row_of = np.searchsorted(start, a, side="right") - 1
                    for i in range(0, len(rows), 8192):
                        cosine = rows[i : i + 8192] @ latent.T
                        at, part = np.nonzero(cosine >= least)
                        if not len(at):
                            continue
                        pair = at * len(items.words) + owner[part]
                        order = np.argsort(pair, kind="stable")
                        pair, value = pair[order], cosine[at, part][order]
                        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                        for x, value in zip(pair[cut].tolist(), np.maximum.reduceat(value, cut).tolist()):
                            p, k = divmod(x, len(items.words))
                            row = int(row_of[i + p])
                            held = best.get((row, k))
                            if held and held[2] >= SURE:
                                continue
                            n = items.matchers[k].n
                            low = first[row] + (a[i + p] - start[row]) * size
                            span = words[max(first[row], low - n) : min(first[row + 1], low + 2 * size + n)].tolist()
                            share = items.matchers[k].common(span) / n
                            if share < LIKELY or held and held[2] >= share:
                                continue
                            answer = items.answers[k]
                            said = Matcher(answer).common(span) / len(answer) if len(answer) else 0.0
                            if share >= SURE or said >= ANSWER:
                                best[row, k] = value, said, share

                if len(words) and len(items.words):
                    half, start = halves(first)
                    term = items.lookup(words)
                    if len(items.short):
                        quarter, begin = halves(first, HALF // 2)
                        parts_of = half_sums(items, term, quarter, int(begin[-1]), table)
                        place = np.arange(begin[-1]) - np.repeat(begin[:-1], np.diff(begin))
                        even = np.flatnonzero(place % 2 == 0)
                        sums = parts_of[even]
                        two = np.flatnonzero(place[np.minimum(even + 1, len(place) - 1)] % 2 == 1)   # those with a second part
                        sums[two] += parts_of[even[two] + 1]
                    else:
                        sums = half_sums(items, term, half, int(start[-1]), table)
                    look(sums, start, HALF, items.latent, items.owner, np.float32(COSINE))
                    if len(items.short):
                        look(parts_of, begin, HALF // 2, items.latent[items.short], items.owner[items.short], items.least_short)
                keys = sorted(best)
                ids = batch.column(0).slice(at, len(piece)).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array([items.ids[k] for _, k in keys], pa.int64()),
                    pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][2] for x in keys], pa.float64()),
                    pa.array([best[x][1] for x in keys], pa.float64())], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])
    return run


FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, cosine, lcs_share, answer_share.

    docs: doc_id, text.  benchmark: item_id, text, and optionally answer (else the last
    sentence of the text is the answer).  A document holds an item of any length if one of
    its passages is a candidate for the item or a passage of it and, with as many words again as the item has on either side, shares a
    subsequence of SURE of the item's words, or of LIKELY of them and ANSWER of the
    answer's.  NULL, empty and blank texts and items hold and match nothing; a NULL
    doc_id or item_id is reported as NULL; repeated rows are reported as often as they
    occur.  Items are read in blocks of ITEM_BLOCK, so the driver and the broadcast stay bounded.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answer = F.col("answer") if "answer" in benchmark.columns else F.regexp_extract(F.rtrim("text"), r"([^.!?\n]*[.!?]*)\z", 1)
    items = benchmark.where(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select(
        F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    n_items = items.count()
    if not n_items:
        return spark.createDataFrame([], FOUND)
    blocks = max(1, -(-n_items // ITEM_BLOCK))
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = Items(sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        counts = texts.select("text").mapInArrow(_frequencies(shipped(spark, part)), "term long, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        frequency = np.zeros(len(part.terms))
        known = counts[counts["term"] >= 0]
        frequency[known["term"].to_numpy()] = known["n"].to_numpy()
        part.weigh(frequency, int(counts.loc[counts["term"] < 0, "n"].sum()))
        part.slots = None
        sketch = texts.select("text").mapInArrow(_sketched(shipped(spark, part), seed), "block long, rows binary") \
            .repartition("block").mapInArrow(_added, "block long, rows binary").toPandas().sort_values("block")
        omega = random_basis(len(part.terms), seed)
        if len(sketch):
            part.basis = singular_vectors(np.concatenate([np.frombuffer(r, dtype=np.float64).reshape(-1, omega.shape[1]) for r in sketch["rows"]]), omega)
        rows = texts.mapInArrow(_found(shipped(spark, part)), FOUND)
        if blocks > 1:
            rows = stored(rows, "found")
        found = rows if found is None else found.unionByName(rows)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    held = stored(contaminated(docs, benchmark).select("doc_id").distinct(), "held")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["doc_id"]), "left_anti")
