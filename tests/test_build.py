"""Features over a graph of sources."""

import numpy as np
import pytest
from helpers import raster

from cellscape.operators import build, stencil

PX = 5.0
NAMES = ["slope", "rough", "svf", "rel_local", "curv", "svf_local"]
GRID = "map_no bigint, crs string, height bigint, width bigint, transform array<double>"


def terrain(h, w):
    i, j = np.mgrid[:h, :w].astype(float)
    return 9 * np.sin((2 * i + j) / 17) + 4 * np.cos(j / 6) + i / 9


def grid(no, height, width, left=0, top=0, crs="moon", px=PX):
    return (no, crs, height, width, [px, 0.0, left * PX, 0.0, -px, -top * PX])


def rows_of(df):
    return {(r["map_no"], r["r"], r["c"]): tuple(r[n] for n in NAMES) for r in df.collect()}


def test_seams_holes_conflicts_and_cycles(spark):
    """Two leaves under a mosaic that looks as if it had never been cut; two claims give nothing."""
    a = terrain(24, 40)
    a[5:9, 17:23] = np.nan
    own = terrain(24, 40)
    own[:, 30] = np.nan
    px = raster(spark, a[:, :20], 1).unionByName(raster(spark, a[:, 20:], 2))
    for no in (3, 4, 5, 6, 7):
        px = px.unionByName(raster(spark, own, no))
    grids = spark.createDataFrame([grid(1, 24, 20), grid(2, 24, 20, 20), *(grid(n, 24, 40) for n in (3, 4, 5, 6)), grid(7, 24, 40, crs=None)], GRID)
    sources = spark.createDataFrame([(3, 1), (3, 2), (3, 2), (4, 2), (4, 3), (5, 6), (6, 5), (7, 3), (8, 3)], "map_no bigint, source bigint")
    want = {(r["r"], r["c"]): tuple(r[n] for n in NAMES) for r in stencil.terrain_features(raster(spark, a), "z", PX).collect()}
    asked = spark.createDataFrame([(3,), (4,), (5,), (7,)], "map_no bigint")
    got = rows_of(build.build(px, grids, sources, asked, "z", PX))
    assert {k[0] for k in got} == {3, 4, 7} and len(got) == 3 * 24 * 40
    for (i, j), w in want.items():
        if j == 30:
            assert got[3, i, j] == got[4, i, j] == (None,) * 6
            continue
        assert all((x is None and y is None) or x == pytest.approx(y, abs=1e-9) for x, y in zip(got[3, i, j], w))
        assert got[4, i, j] == (got[3, i, j] if j < 20 else (None,) * 6)     # the right half is claimed twice
    issues = {tuple(r) for r in build.source_issues(px, grids, sources, asked).collect()}
    assert issues == {(4, 2, "overlaps source 3 on 480 pixels"), (5, None, "waits for a cycle"), (6, None, "waits for a cycle"), (7, 3, "no CRS")}


def test_levels_are_dropped_after_their_last_consumer(spark, monkeypatch):
    dropped = []
    monkeypatch.setattr(build, "drop_stored", lambda *t: dropped.append(len(t)))
    a = terrain(16, 16)
    px = raster(spark, a, 0)
    for no in (1, 2, 3):
        px = px.unionByName(raster(spark, a, no))
    grids = spark.createDataFrame([grid(n, 16, 16) for n in range(4)], GRID)
    chain = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "map_no bigint, source bigint")
    got = rows_of(build.build(px, grids, chain, spark.createDataFrame([(3,), (1,)], "map_no bigint"), "z", PX))
    assert dropped == [1, 1] and {k[0] for k in got} == {1, 3}        # levels 0 and 2; level 1 was asked for
    assert all(got[1, i, j] == got[3, i, j] for i in range(16) for j in range(16))
    assert build.build(px, grids, chain, spark.createDataFrame([], "map_no bigint"), "z", PX).count() == 0


def test_companions(spark):
    a = terrain(6, 6)
    a[2, 2] = np.nan
    px = raster(spark, a, 1)
    other = raster(spark, np.arange(9.0).reshape(3, 3), 1).selectExpr("*", "array(10D, 0D, 0D, 0D, -10D, 0D) AS transform", "z AS v").drop("z")
    target = spark.createDataFrame([grid(1, 6, 6)], GRID)
    nearest = {(r["r"], r["c"]): r["psr"] for r in build.companion_channel(px, other, target, "v", "psr", "z").collect()}
    assert nearest == {(i, j): None if (i, j) == (2, 2) else float(i // 2 * 3 + j // 2) for i in range(6) for j in range(6)}
    clipped = [r["cpr"] for r in build.companion_channel(px, other, target, "v", "cpr", "z").collect()]
    smooth = [r["nac"] for r in build.companion_channel(px, other, target, "v", "nac", "z").collect()]
    assert clipped.count(None) == smooth.count(None) + 2      # the two extremes


def test_maps_that_feed_nothing_are_not_built(spark, monkeypatch):
    """A source that no link can use is no leaf: leaves in contexts are then all there is, and no pixel is read to size the rest."""
    lone, made = [], stencil.context_features
    monkeypatch.setattr(stencil, "context_features", lambda *a, **b: (lone.append(a[5]), made(*a, **b))[1])
    a = terrain(8, 8)
    px = raster(spark, a[:, :4], 1).unionByName(raster(spark, a[:, 4:], 2)).unionByName(raster(spark, a, 3)).unionByName(raster(spark, a, 4))
    grids = spark.createDataFrame([grid(1, 8, 4), grid(2, 8, 4, 4), grid(3, 8, 8)], GRID)
    sources = spark.createDataFrame([(3, 1), (3, 2), (3, 4)], "map_no bigint, source bigint")      # 4 has no grid
    asked = spark.createDataFrame([(3,)], "map_no bigint")
    assert len(rows_of(build.build(px, grids, sources, asked, "z", PX))) == 64 and lone == [False]
    both = rows_of(build.build(px, grids, sources, spark.createDataFrame([(3,), (4,)], "map_no bigint"), "z", PX))
    assert {k[0] for k in both} == {3, 4} and lone == [False, True]
