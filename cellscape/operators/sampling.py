"""Reproducible samples, pages and ordered sets.

The order of a sample is the MD5 of the row key and a seed, so that any engine draws the
same rows.  Group sizes are unbounded, limits are not: rows are first ranked inside hash
slices of their group, and only each slice's front reaches the final ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscape.functions.constants import (
    MAX_TRAIN_ROWS,
    PAGE_SIZE,
    PER_CELL,
    PER_STRATUM,
)
from cellscape.operators.grid import with_cells

# Up to this many rows per group Spark itself ranks before the shuffle.
RANK_BEFORE_SHUFFLE = 1000


def draw_order(*parts: Column | str, seed: int = 0) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def first_per_group(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The k rows with the smallest (unique) order value of every group."""
    final = Window.partitionBy(*keys).orderBy(order)
    if k > RANK_BEFORE_SHUFFLE:
        sliced = df.withColumn("_slice", F.substring(order, 1, 3))
        inner = Window.partitionBy(*keys, "_slice").orderBy(order)
        df = sliced.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= k).drop("_rank", "_slice")
    return df.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= k).drop("_rank")


def stratified(labelled: DataFrame, per_stratum: int = PER_STRATUM, seed: int = 0) -> DataFrame:
    """Up to per_stratum usable pixels of every (map, unit).

    labelled: map_no, r, c, label, w and the features (slope decides on terrain).
    """
    usable = labelled.where("label is not null and w > 0 and slope is not null")
    keyed = usable.withColumn("_order", draw_order("map_no", "r", "c", seed=seed))
    return first_per_group(keyed, ["map_no", "label"], "_order", per_stratum).drop("_order")


def per_cell(px: DataFrame, cells: DataFrame, grid: int, limit: int = PER_CELL, seed: int = 0) -> DataFrame:
    """R2: up to `limit` terrain pixels of every painted cell."""
    painted = cells.where("code > 0").select("map_no", "ci", "cj", "code")
    inside = with_cells(px.where("slope is not null"), grid).join(painted, ["map_no", "ci", "cj"])
    keyed = inside.withColumn("_order", draw_order("map_no", "r", "c", seed=seed))
    return first_per_group(keyed, ["map_no", "ci", "cj"], "_order", limit).drop("_order")


def balanced_cap(samples: DataFrame, cap: int = MAX_TRAIN_ROWS, seed: int = 0) -> DataFrame:
    """Beyond `cap` rows keep cap // n_classes of each unit.

    A count per hash prefix finds the prefix at which each unit's share is full; only
    rows up to that prefix are ranked.  There are three units, so the cut table has
    three rows.
    """
    keyed = samples.withColumn("_order", draw_order("map_no", "r", "c", seed=seed)).withColumn(
        "_prefix", F.substring("_order", 1, 4)
    )
    # Three units times 65536 prefixes at most, so these windows are small.
    hist = keyed.groupBy("label", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    unit = Window.partitionBy("label")
    totals = hist.withColumns({
        "_before": F.sum("n").over(unit.orderBy("_prefix")) - F.col("n"),
        "_total": F.sum("n").over(Window.partitionBy(F.lit(0))),
        "_units": F.size(F.collect_set("label").over(Window.partitionBy(F.lit(0)))),
    }).withColumn("_share", F.when(F.col("_total") > cap, F.floor(F.lit(cap) / F.col("_units"))))
    cuts = totals.where("_share is null or _before < _share").groupBy("label", "_share").agg(F.max("_prefix").alias("_cut"))
    near = keyed.join(cuts, "label").where("_prefix <= _cut")
    rank = F.row_number().over(unit.orderBy("_order"))
    kept = near.withColumn("_rank", rank).where("_share is null or _rank <= _share")
    return kept.select(*samples.columns)


def page(listing: DataFrame, order: list[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a stable listing."""
    return listing.orderBy(*order).offset(size * (number - 1)).limit(size)


def sections(listing: DataFrame) -> DataFrame:
    """The sections on offer."""
    return listing.select("section").distinct()


def first_positions(names: DataFrame, name: str, position: str) -> DataFrame:
    """Duplicates collapse onto their first position; order by it to list them."""
    return names.groupBy(name).agg(F.min(position).alias(position))
