"""Training rows, memory and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import GRID
from cellscape.functions.raster import bounds, label_weight
from cellscape.operators.grid import CELL, with_cells
from cellscape.session import large


def training_pixels(px: DataFrame, cells: DataFrame, grid: int = GRID) -> DataFrame:
    """Unit and weight of every painted pixel.

    Unlike a label map this keeps pixels on holes; sampling asks for terrain later.
    """
    painted = cells.where("code > 0").select(
        *CELL, F.col("code").alias("label"),
        label_weight(F.col("code"), F.col("conf"), F.col("accepted")).alias("w"),
    )
    return with_cells(px, grid).join(painted, list(CELL))


def of_verified(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples of maps whose merged metadata says verified, exactly true."""
    verified = meta.where("key = 'verified' and value = 'true'").select("map_no")
    return samples.join(verified, "map_no", "left_semi")


def changed_inputs(current: DataFrame, recorded: DataFrame, fields: list[str]) -> DataFrame:
    """Maps whose training input appeared, vanished or differs in one of `fields`.

    A record from before status tracking is compared on fewer fields.
    """
    a = current.select("map_no", F.struct(*fields).alias("now"))
    b = recorded.select("map_no", F.struct(*fields).alias("then"))
    both = a.join(b, "map_no", "full_outer")
    status = (
        F.when(F.col("then").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    )
    return both.select("map_no", status.alias("status")).where("status is not null")


def footprints(current: DataFrame, remembered: DataFrame) -> DataFrame:
    """Bounds and shape from the map's own grid, else the remembered ones.

    current: map_no, crs, height, width, transform.  remembered: map_no, crs, l, b, r, t.
    """
    own = current.select("map_no", F.col("crs").alias("own_crs"), bounds("transform", "height", "width").alias("own"))
    both = own.join(remembered, "map_no", "full_outer")
    known = F.col("own.l").isNotNull()
    return both.select(
        "map_no", F.when(known, F.col("own_crs")).otherwise(F.col("crs")).alias("crs"),
        *[F.when(known, F.col(f"own.{x}")).otherwise(F.col(x)).alias(x) for x in ("l", "b", "r", "t")],
        F.when(known, "current").otherwise("remembered").alias("source"),
    )


def memory_summary(samples: DataFrame, maps: DataFrame) -> DataFrame:
    """Tiles, map groups, geographies and rows of the training memory.

    maps: map_no, map_group, geography.  Rows are counted per map first, so distinct
    counts run over maps and not over pixels.
    """
    per_map = samples.groupBy("map_no").agg(F.count(F.lit(1)).alias("rows"))
    return per_map.join(maps, "map_no", "left").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_distinct(F.coalesce("map_group", F.col("map_no").cast("string"))).alias("map_groups"),
        F.count_distinct(F.coalesce("geography", F.col("map_no").cast("string"))).alias("geography_groups"),
        F.sum("rows").alias("sampled_pixels"),
    )


def transported(claims: DataFrame, px: DataFrame, names: list[str]) -> DataFrame:
    """Features of declared sources on the target pixels; NULL outside their coverage
    and on the target's own holes.

    claims: map_no, r, c, source and names, already on the target grid, a row for every pixel a
    source covers.  A pixel that two sources claim gets features from neither: it is an error,
    told by `overlap.contested_pixels`.

    Pixels and claims meet in one aggregate with buffers of fixed width, so nothing is sorted.
    """
    key = ["map_no", "r", "c"]
    own = px.select(*key, F.col("z").isNotNull().alias("_seen"))
    met = own.unionByName(claims.select(*key, "source", *names), allowMissingColumns=True).groupBy(*key).agg(
        F.max("_seen").alias("_seen"), F.min("source").alias("_first"), F.max("source").alias("_last"), *[F.max(n).alias(n) for n in names])
    told = F.col("_seen") & (F.col("_first") == F.col("_last"))
    return met.where("_seen is not null").select(*key, *[F.when(told, F.col(n)).alias(n) for n in names])
