"""Features of maps that take them from other maps: a runner over the graph of sources.

Maps without sources get their six features from their own terrain, joined with adjoining
ones so that seams vanish; every other map takes them from its sources by nearest regrid.
The graph is worked off level by level: a level is written once, read by the levels that
consume it, and deleted after the last of them unless it was asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import BASE_FEATURES, REL_M
from cellscape.operators import distribution, graph, regrid, stencil
from cellscape.operators.training import transported
from cellscape.session import drop_stored, large, stored

GRID_COLUMNS = ["crs", "height", "width", "transform"]


def needed_maps(sources: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested maps and whatever they reach over their sources: (map_no)."""
    links = sources.select(F.col("source").alias("u"), F.col("map_no").alias("d"), F.lit(0).alias("w"))
    nodes = requested.select(F.col("map_no").alias("node"), F.lit(1).alias("base")).unionByName(
        links.select(F.col("u").alias("node")).unionByName(links.select(F.col("d").alias("node"))).withColumn("base", F.lit(0)))
    return graph.settled(nodes, links, top=1).where("value = 1").select(F.col("node").alias("map_no"))


def usable_links(sources: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with both grids, and an issue row for every link that cannot carry features.

    Both ends need one CRS; without any, their grids must be equal.
    """
    both = sources.select("map_no", "source").distinct().join(
        grids.select("map_no", F.struct(*GRID_COLUMNS).alias("target")), "map_no", "left").join(
        grids.select(F.col("map_no").alias("source"), F.struct(*GRID_COLUMNS).alias("origin")), "source", "left")
    issue = (
        F.when(F.col("target").isNull() | F.col("origin").isNull(), "unknown map")
        .when(~F.col("target").eqNullSafe(F.col("origin")) & (F.col("target.crs").isNull() | F.col("origin.crs").isNull()), "no CRS")
        .when(~F.col("target.crs").eqNullSafe(F.col("origin.crs")), "other CRS")
    )
    both = stored(both.withColumn("issue", issue), "links")
    return both.where("issue is null").drop("issue"), both.where("issue is not null").select("map_no", "source", "issue")


def claims_of(features: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """What the pixels of all sources bring to their consumers: map_no, r, c, source and names.

    Every pixel of a source claims what it covers, also where it has no features.
    """
    rows = features.withColumnRenamed("map_no", "source").join(links, "source").select(
        "map_no", "source", "r", "c", *names, F.col("origin.transform").alias("transform"), F.col("target.transform").alias("t_transform"),
        F.col("target.height").alias("t_height"), F.col("target.width").alias("t_width"))
    return regrid.regrid_nearest(rows, ["map_no", "source"], names)


def conflicts_of(claims: DataFrame) -> DataFrame:
    """Pairs of sources (the first and the last) that claim the same pixels: map_no, source, issue."""
    shared = claims.groupBy("map_no", "r", "c").agg(F.min("source").alias("source"), F.max("source").alias("other")).where("source <> other")
    return shared.groupBy("map_no", "source", "other").agg(F.count(F.lit(1)).alias("pixels")).select(
        "map_no", "source", F.concat_ws(" ", F.lit("overlaps source"), "other", F.lit("on"), "pixels", F.lit("pixels")).alias("issue"))


def planned(grids: DataFrame, sources: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, levels, issues) of the maps that the requested ones need; reads no pixel.

    links: map_no, source, target, origin.  levels: map_no, level (NULL: waits for a cycle).
    """
    need = stored(needed_maps(sources, requested), "needed")
    links, issues = usable_links(sources.join(need, "map_no", "left_semi"), grids)
    levels = stored(graph.dependency_levels(
        links.select(F.col("map_no").alias("node"), F.col("source").alias("dep")), need.select(F.col("map_no").alias("node"))
    ).withColumnRenamed("node", "map_no"), "levels")
    cycles = levels.where("level is null").select("map_no", F.lit(None).cast(sources.schema["source"].dataType).alias("source"), F.lit("waits for a cycle").alias("issue"))
    return links, levels, issues.unionByName(cycles)


def source_issues(px: DataFrame, grids: DataFrame, sources: DataFrame, requested: DataFrame) -> DataFrame:
    """What would keep features away from the requested maps, told before any is computed.

    map_no, source, issue: links that cannot be used, maps that wait for a cycle, and sources
    that claim the same pixels of a map that does not.
    """
    links, levels, issues = planned(grids, sources, requested)
    sound = links.join(levels.where("level is not null"), "map_no", "left_semi")
    return issues.unionByName(conflicts_of(claims_of(px.select("map_no", "r", "c"), sound, [])))


def build(px: DataFrame, grids: DataFrame, sources: DataFrame, requested: DataFrame, value: str,
          pixel_metres: float, block: int = stencil.BLOCK) -> DataFrame:
    """The six features of the requested maps: map_no, r, c and the names.

    px: map_no, r, c, height, width and the terrain `value`, a row for every pixel.  grids:
    map_no, crs, height, width, transform.  sources: map_no, source.  requested: map_no.
    Features are NULL on holes of the map itself, where no source reaches, and where two do.
    Maps that wait for a cycle have no rows.  `source_issues` tells of all these.

    Maps that are asked for and feed no other are built from their own terrain; leaves that feed
    requested maps share a context with those they adjoin.
    """
    names = list(BASE_FEATURES)
    requested = stored(requested.select("map_no").distinct(), "requested")     # a row per map: Spark sees how small it is
    links, levels, _ = planned(grids, sources, requested)
    graded = stored(links.join(levels.where("level is not null"), "map_no").join(
        levels.select(F.col("map_no").alias("source"), F.col("level").alias("from")), "source"), "graded")
    # Only maps that feed another or are asked for are built; what unusable links name is neither.
    wanted = graded.select(F.col("source").alias("map_no")).unionByName(requested)
    levels = stored(levels.where("level is not null").join(wanted, "map_no", "left_semi"), "wanted")
    used = {(r["from"], r["level"]) for r in graded.select("from", "level").distinct().collect()}   # pairs of levels
    asked = {r["level"] for r in levels.join(requested, "map_no", "left_semi").select("level").distinct().collect()}

    made: dict[int, DataFrame] = {}
    for level in range(max(asked, default=-1) + 1):
        own = levels.where(F.col("level") == level).select("map_no")
        if level == 0:
            feeding = own.join(graded.select(F.col("source").alias("map_no")), "map_no", "left_semi")
            contexts = graph.tile_contexts(grids.join(feeding, "map_no", "left_semi"))
            lone = not own.join(contexts.select("map_no"), "map_no", "left_anti").isEmpty()
            out = stencil.context_features(px.join(own, "map_no", "left_semi"), contexts, value, pixel_metres, block, lone)
        else:
            parts = [made[k] for k in sorted(made) if (k, level) in used]
            brought = claims_of(reduce(DataFrame.unionByName, parts), graded.where(F.col("level") == level), names)
            out = transported(brought, px.join(own, "map_no", "left_semi").withColumn("z", F.col(value)), names)
        made[level] = stored(out, f"level{level}")
        for k in [k for k in made if k not in asked and not any(a == k and b > level for a, b in used)]:
            drop_stored(made.pop(k))      # its last consumer is done
    if not made:
        return px.select("map_no", "r", "c", *[F.lit(None).cast("double").alias(n) for n in names]).limit(0)
    return reduce(DataFrame.unionByName, made.values()).join(requested, "map_no", "left_semi")


def local_channels(px: DataFrame, value: str, pixel_metres: float, block: int = stencil.BLOCK) -> DataFrame:
    """Channels that a map has from its own terrain alone: rel, zscene, hillshade.

    Height above the wide surroundings and above the median of the scene, NULL on holes; relief,
    0 on holes.  All three are computed on filled terrain.
    """
    filled = stencil.nearest_fill(px, value).select("map_no", "r", "c", "height", "width", "hole", "filled")
    ground = stored(filled, "ground")
    key = ["map_no", "r", "c"]
    rel = stencil.local_height(ground, "filled", REL_M, pixel_metres, block).withColumnRenamed("local_height", "rel")
    shade = stencil.hillshade(ground, "filled", pixel_metres, block=block)
    scene = distribution.scene_relative(ground, "filled").select(*key, "hole", "zscene")
    seen = lambda c: F.when(~F.col("hole"), F.col(c)).alias(c)
    return scene.join(large(rel), key).join(large(shade), key).select(
        *key, seen("rel"), seen("zscene"), F.when(F.col("hole"), 0.0).otherwise(F.col("shade")).alias("shade"))


def companion_channel(px: DataFrame, companion: DataFrame, target: DataFrame, value: str, kind: str, terrain: str) -> DataFrame:
    """A companion raster on the map's grid: nearest for `psr`, else bilinear; `cpr` without its extreme values.

    px: map_no, r, c and the terrain, on whose holes the channel is NULL.  companion: map_no, r,
    c, height, width, transform and the value.  target: map_no, height, width, transform.
    """
    src = companion.join(target.select("map_no", F.col("height").alias("t_height"), F.col("width").alias("t_width"), F.col("transform").alias("t_transform")), "map_no")
    moved = regrid.regrid_nearest(src, ["map_no"], [value]) if kind == "psr" else regrid.regrid_bilinear(src, ["map_no"], value)
    if kind == "cpr":
        moved = distribution.robust_clip(stored(moved, "companion"), value)
    return px.select("map_no", "r", "c", F.col(terrain).alias("_t")).join(large(moved), ["map_no", "r", "c"], "left").select(
        "map_no", "r", "c", F.when(F.col("_t").isNotNull(), F.col(value)).alias(kind))
