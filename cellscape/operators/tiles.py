"""Tiling: canonical layout, pixel addressing, coverage and region checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import TILE_SIZE
from cellscape.functions.raster import int_div, shifted


def tile_name(region: Column, row: Column, column: Column) -> Column:
    return F.format_string("zenodo-%s-r%03d-c%03d", region, row, column)


def tile_layout(regions: DataFrame, size: int = TILE_SIZE) -> DataFrame:
    """Row-major windows of `size`, edges kept unpadded.

    `regions`: region, height, width, transform.
    """
    def starts(extent: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), int_div(F.col(extent) - 1, size))

    return (
        regions.where("height > 0 and width > 0")
        .select("*", F.explode(starts("height")).alias("tile_row"))
        .select("*", F.explode(starts("width")).alias("tile_col"))
        .withColumns({"row_off": F.col("tile_row") * size, "col_off": F.col("tile_col") * size})
        .select(
            "region",
            tile_name(F.col("region"), F.col("tile_row"), F.col("tile_col")).alias("tile_id"),
            "tile_row", "tile_col", "row_off", "col_off",
            F.least(F.lit(size), F.col("height") - F.col("row_off")).cast("bigint").alias("tile_height"),
            F.least(F.lit(size), F.col("width") - F.col("col_off")).cast("bigint").alias("tile_width"),
            shifted("transform", "row_off", "col_off").alias("transform"),
        )
    )


def with_tiles(px: DataFrame, size: int = TILE_SIZE) -> DataFrame:
    """Tile and position inside the tile, a pure projection."""
    return px.withColumns({
        "tile_row": int_div(F.col("r"), size), "tile_col": int_div(F.col("c"), size),
        "lr": F.col("r") % size, "lc": F.col("c") % size,
    })


def layout_differences(recorded: DataFrame, layout: DataFrame) -> DataFrame:
    """Recorded tiles that are missing, unexpected or cut differently.

    Both sides carry region, tile_id, position (row-major order) and the window.
    """
    window = ["row_off", "col_off", "tile_height", "tile_width"]
    a = recorded.select("region", "tile_id", F.lit(True).alias("in_a"),
                        F.struct("position", *window).alias("a"))
    b = layout.select("region", "tile_id", F.lit(True).alias("in_b"),
                      F.struct("position", *window).alias("b"))
    both = a.join(b, ["region", "tile_id"], "full_outer")
    problem = (
        F.when(F.col("in_a").isNull(), "missing")
        .when(F.col("in_b").isNull(), "unexpected")
        .when(F.col("a.position") != F.col("b.position"), "order")
        .when(F.col("a") != F.col("b"), "window")
    )
    return both.select("region", "tile_id", problem.alias("problem")).where("problem is not null")


def tile_counts(px: DataFrame, keys: list[str]) -> DataFrame:
    """Valid, valid_data and supported pixels per tile."""
    from cellscape.functions.raster import sfs_support, valid_data

    return px.groupBy(*keys).agg(
        F.count("sfs").alias("valid_count"),
        F.count_if(valid_data("sfs", "nac")).alias("valid_data_count"),
        F.count_if(sfs_support("sfs", "image_count")).alias("sfs_support_count"),
    )


def nominal_placement(maps: DataFrame) -> DataFrame:
    """T5: where a cropped tile sits inside its nominal square.

    `maps`: map_no, section, crs, height, width, transform.  The largest square peer of
    the same section, spacing and CRS whose lattice fits gives the square; without one
    the tile anchors its own square at the upper left.

    Peers enter the join as distinct (section, CRS, spacing, side, lattice phase)
    classes, so copies of one origin cost one candidate; a phase is the origin
    modulo the side, which is all that the placement depends on.
    """
    t = F.col("transform")
    spacing = F.concat_ws(",", *[F.round(t[i], 8).cast("string") for i in (0, 1, 3, 4)])
    base = maps.withColumns({
        "spacing": spacing,
        "x": t[2] / t[0], "y": t[5] / t[4],
        "side": F.greatest("height", "width"),
    })
    # Half-open phase of an origin on a lattice of `side`, to 1e-5 of a pixel.
    def whole(v: Column) -> Column:
        return F.abs(v - F.rint(v)) <= 1e-5

    peers = (
        base.where("height = width")
        .select(
            "section", "spacing", "crs", F.col("height").alias("peer_side"),
            F.round(F.pmod(F.col("x"), F.col("height").cast("double")), 6).alias("px"),
            F.round(F.pmod(F.col("y"), F.col("height").cast("double")), 6).alias("py"),
        )
        .distinct()
        .withColumnRenamed("crs", "peer_crs")
    )
    joined = base.join(peers, ["section", "spacing"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    col_ = F.pmod(F.rint(dx), F.col("peer_side").cast("double")).cast("bigint")
    row_ = F.pmod(F.rint(dy), F.col("peer_side").cast("double")).cast("bigint")
    fits = (
        (F.col("peer_side") >= F.col("side"))
        & (F.col("crs").isNull() | F.col("peer_crs").isNull() | (F.col("crs") == F.col("peer_crs")))
        & whole(dx) & whole(dy)
        & (col_ + F.col("width") <= F.col("peer_side"))
        & (row_ + F.col("height") <= F.col("peer_side"))
    )
    best = joined.where(fits).groupBy("map_no").agg(
        F.max(F.struct("peer_side", (-row_).alias("nr"), (-col_).alias("nc"))).alias("best")
    )
    placed = base.join(best, "map_no", "left").select(
        "map_no", "height", "width",
        F.coalesce("best.peer_side", "side").alias("side"),
        F.coalesce(-F.col("best.nr"), F.lit(0)).alias("row_in"),
        F.coalesce(-F.col("best.nc"), F.lit(0)).alias("col_in"),
    )
    side = F.col("side").cast("double")
    return placed.select(
        "map_no", "side", "row_in", "col_in",
        (F.col("col_in") / side).alias("x"), (F.col("row_in") / side).alias("y"),
        (F.col("width") / side).alias("w"), (F.col("height") / side).alias("h"),
    )
