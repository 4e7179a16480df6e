"""Tables that grow with the input are never gathered in the driver, however small their files look."""

import re

from cellscape.functions.constants import BASE_FEATURES
from cellscape.operators import build, distribution, stencil, training


def pixels(spark):
    return spark.range(2 * 64 * 64).selectExpr(
        "id div 4096 map_no", "id div 64 % 64 r", "id % 64 c", "64L height", "64L width", "CASE WHEN id % 7 > 0 THEN id % 13 END z")


def pixel_broadcasts(df):
    """Joins on pixels that would send a side to everyone, by the plan before any size is measured."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Broadcast\w*Join.*\br\w*#\d+L?, c\w*#", line)]


def test_channels_merge_pixels(spark):
    assert not pixel_broadcasts(build.local_channels(pixels(spark), "z", 5.0))


def test_features_merge_pixels(spark):
    px = pixels(spark)
    assert not pixel_broadcasts(stencil.terrain_features(px, "z", 5.0))
    names = list(BASE_FEATURES)
    claims = px.selectExpr("map_no", "r", "c", "7L source", *[f"0.5D {n}" for n in names])
    assert not pixel_broadcasts(training.transported(claims, px, names))


def test_ranks_keep_pixels_at_home(spark):
    px = pixels(spark)
    made = distribution.scene_relative(px, "z")
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan
    # A map without any value keeps its pixels.
    blank = distribution.scene_relative(px.selectExpr("map_no", "r", "c", "CASE WHEN map_no = 0 THEN z END z"), "z")
    assert blank.where("map_no = 1").count() == 4096 and blank.where("map_no = 1 and zscene is not null").count() == 0
