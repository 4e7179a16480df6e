"""Maps that are one block take one shuffle, and give what the passes in blocks give."""

import numpy as np
import pytest
from helpers import raster

from cellscape.functions.constants import BASE_FEATURES
from cellscape.operators import stencil, training
from cellscape.plans.terrain import source_graph
from cellscape.plans.views import Views

PX = 5.0
SHAPES = [(1, 1), (1, 9), (7, 1), (2, 3), (24, 41), (40, 17), (64, 64)]


def terrain(h, w, seed):
    i, j = np.mgrid[:h, :w].astype(float)
    a = 9 * np.sin((2 * i + j) / 7) + 4 * np.cos(j / 6 + seed) + i / 9
    a[np.random.default_rng(seed).random((h, w)) < 0.2] = np.nan
    a[h // 3:h // 2, w // 4:w // 2] = np.nan
    a[0, 0] = 1.0
    return a


def rows_of(df):
    return {(r["map_no"], r["r"], r["c"]): tuple(r[n] for n in BASE_FEATURES) for r in df.collect()}


def test_whole_maps_match_blocks(spark):
    px = raster(spark, np.full((5, 4), np.nan), 99)      # without any known pixel: no rows
    for n, shape in enumerate(SHAPES):
        px = px.unionByName(raster(spark, terrain(*shape, n), n))
    whole = stencil.terrain_features(px, "z", PX)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = rows_of(whole)
    assert len(got) == sum(h * w for h, w in SHAPES)
    for block in (16, 30):      # some maps are larger than a block, some not
        want = rows_of(stencil.terrain_features(px, "z", PX, block))
        assert got.keys() == want.keys()
        for key, values in want.items():
            for x, y in zip(got[key], values):
                assert (x is None and y is None) or x == pytest.approx(y, abs=1e-9), (block, key)


def test_lone_leaves_beside_a_context(spark):
    """One pass builds both, and the columns that are carried come back as they went."""
    a = terrain(20, 32, 3)
    px = raster(spark, a[:, :12], 1).unionByName(raster(spark, a[:, 12:], 2)).unionByName(raster(spark, a, 8)).unionByName(raster(spark, a, 9))
    tiles = spark.createDataFrame([(1, 1, 0, 0, 20, 12), (2, 1, 0, 12, 20, 20)], "map_no long, context long, top long, left long, height long, width long")
    made = stencil.context_features(px.where("map_no < 9"), tiles, "z", PX, lone=True)
    got = rows_of(made)
    assert len(got) == 2 * 20 * 32
    for i in range(20):
        for j in range(32):
            x = got[(1, i, j) if j < 12 else (2, i, j - 12)]
            assert all((u is None and v is None) or u == pytest.approx(v, abs=1e-9) for u, v in zip(x, got[8, i, j]))
    assert {k[0] for k in rows_of(stencil.context_features(px, tiles, "z", PX))} == {1, 2}


def test_claims_and_pixels_meet_without_a_sort(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, None), (1, 0, 2, 5), (1, 0, 3, 5), (1, 0, 4, 5)], "map_no long, r long, c long, z long")
    claims = spark.createDataFrame([(1, 0, 0, 7, 0.5), (1, 0, 1, 7, 0.5), (1, 0, 2, 7, 0.5), (1, 0, 2, 8, 0.5), (1, 0, 4, 8, None), (1, 9, 9, 7, 0.5)],
                                   "map_no long, r long, c long, source long, slope double")
    made = training.transported(claims, px, ["slope"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Join" not in plan
    assert sorted(map(tuple, made.collect())) == [(1, 0, 0, 0.5), (1, 0, 1, None), (1, 0, 2, None), (1, 0, 3, None), (1, 0, 4, None)]


def test_the_source_graph_reads_written_pixels(spark, tables):
    """Six kinds of map at every level: the vectors are not shuffled and unfolded again for each."""
    px, grids, sources, requested = source_graph(Views(spark, tables))
    for df in (px, grids, sources, requested):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "embeddings" not in plan
