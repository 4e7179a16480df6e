"""Vector codes against plain k-means on integers."""

import hashlib

import numpy as np
import pytest

from cellscape.llm import vector_codes


def plain(rows, parts, entries, rounds, scale):
    x = np.floor(scale * np.array([r[2] for r in rows], dtype=np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [x[first, p].copy() for p in range(parts)]
    for r in range(rounds + 1):
        near = [((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)]
        for p in range(parts):
            for e in set(near[p]) if r < rounds else ():
                books[p][e] = [int(s) // int((near[p] == e).sum()) for s in x[near[p] == e, p].sum(0)]
    error = sum(((x[:, p] - books[p][near[p]]) ** 2).sum(1) for p in range(parts))
    labels = {}
    for row, e in zip(rows, error):
        labels[row[1]] = labels.get(row[1], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for entry in b for v in entry).encode()).hexdigest()
    return [(row[0], "".join(f"{near[p][i]:02x}" for p in range(parts)), int(error[i]), labels[row[1]], digest) for i, row in enumerate(rows)]


@pytest.mark.parametrize("parts, entries, rounds, scale", [(8, 16, 6, 4096), (2, 5, 9, 10), (4, 1, 2, 100), (1, 128, 3, 50)])
def test_equals_plain_rounds(spark, parts, entries, rounds, scale):
    rng = np.random.default_rng(parts)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), int(i % 3) if i % 5 else None, [float(v) for v in base[rng.integers(12)] + rng.choice([0, 0.05, 0.6]) * rng.normal(size=16)]) for i in rng.permutation(400)]
    rows += [(7, 1, rows[0][2]), (7, 1, rows[0][2]), (None, 0, rows[1][2])]     # repeated rows, no id
    odd = [(900, 0, None), (901, 0, []), (902, 0, [None] + [1.0] * 15), (903, 0, [float("nan")] * 16), (904, 0, [float("inf")] * 16), (-1, 0, [1.0] * 32 + [2.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS part", "2 AS x", "3 AS n", "4 AS code")
    if parts == 1:
        df = df.where("vec_id IS NULL OR vec_id >= 0")       # a vector of 35 parts would name the dimension
    got = vector_codes.compressed(df, parts, entries, rounds, scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, parts, entries, rounds, scale), key=repr)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, 1, None)], schema)).count() == 0
    rows = [(5, None, [0.5] * 8), (6, None, [-0.5] * 8)]
    assert [tuple(r)[:4] for r in vector_codes.compressed(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()] == [(5, "00" * 8, 0, 0), (6, "01" * 8, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compressed(spark.createDataFrame([(1, 1, [1e30] * 8)], schema)).count()


def test_bounds_never_lose_the_nearest_entry():
    """Drifting entries: what the bounds settle equals a full search, also for ties."""
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (500, 3))
    book = x[:16].copy()
    state = vector_codes.Bounds.first(x, book, 4)
    for b in (4, 4, 3, 2, 2, 2):
        new = book + rng.integers(-3, 4, book.shape)
        state.move(np.array([vector_codes.root_above(int(s)) for s in ((new - book) ** 2).sum(1)]))
        state.narrow(b)
        book = new
        needed = state.settle(x, book)
        assert (state.own == ((x[:, None] - book) ** 2).sum(2).argmin(1)).all() and len(needed) < len(x)
