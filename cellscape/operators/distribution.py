"""Exact order statistics per map, in two counting passes, without gathering a map in one task.

The first pass counts values per (map, step), where steps divide the value axis like a
floating-point number does: sign, exponent and STEPS parts of each power of two.  Its few
rows per map tell in which step every wanted rank lies.  The second pass counts the exact
values of those steps alone.  Both combine on the map side, and what is ranked are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscape.session import stored

STEPS = 256              # steps of a power of two
LIFT = 1 << 19           # more than STEPS times the greatest exponent of a double


def step_of(value: Column) -> Column:
    """The step of a number: never lower for a higher number (logarithms are monotonic, floors too)."""
    x = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(x)) * STEPS, F.lit(300000.0))) + LIFT
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size)


def exact_percentiles(px: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Linearly interpolated percentiles (0..1) per key, as q0, q1, ..., with n, lo and hi.

    NULL and NaN are not counted; keys without a value have no row.
    """
    counted = px.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).alias("_v"), step_of(F.col(value)).alias("_s"))
    steps = counted.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = Window.partitionBy(*keys)
    steps = steps.withColumns({
        "_end": F.sum("_n").over(whole.orderBy("_s")), "n": F.sum("_n").over(whole), "lo": F.min("_lo").over(whole), "hi": F.max("_hi").over(whole)})
    ranks = []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("n") - 1)
        first = F.floor(at)
        for rank in (first, F.least(first + 1, F.col("n") - 1)):
            ranks.append(F.struct(F.lit(i).alias("i"), rank.alias("rank"), (at - first).alias("frac")))
    before = F.col("_end") - F.col("_n")
    here = F.filter(F.array(*ranks), lambda w: (w["rank"] >= before) & (w["rank"] < F.col("_end")))
    wanted = steps.select(*keys, "_s", F.struct(before.alias("before"), "n", "lo", "hi", here.alias("ranks")).alias("_w")).where(F.size("_w.ranks") > 0)

    # Few rows a key; written, so that Spark knows it and does not take the pixels for the smaller side.
    wanted = stored(wanted, "ranks")
    exact = counted.join(wanted, [*keys, "_s"]).groupBy(*keys, "_s", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_w").alias("_w"))
    end = F.col("_w.before") + F.sum("_n").over(Window.partitionBy(*keys, "_s").orderBy("_v"))
    found = (
        exact.withColumn("_end", end).withColumn("_r", F.explode("_w.ranks")).where("_r.rank >= _end - _n and _r.rank < _end")
        .groupBy(*keys, F.col("_r.i").alias("_i"))
        .agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.max("_r.frac").alias("_frac"), F.first("_w").alias("_w"))
        .withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_frac"))
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(points))],
        *[F.first(f"_w.{c}").alias(c) for c in ("n", "lo", "hi")])


def robust_clip(px: DataFrame, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Values outside the central percentiles become NULL."""
    q = exact_percentiles(px, ["map_no"], value, [low, high]).select("map_no", "q0", "q1")
    kept = F.when((F.col(value) >= F.col("q0")) & (F.col(value) <= F.col("q1")), F.col(value))
    return px.join(q, "map_no", "left").withColumn(value, kept).drop("q0", "q1")


def stretched(px: DataFrame, value: str) -> DataFrame:
    """2nd..98th percentile to 0..1, full range when flat, 0 where unknown."""
    q = exact_percentiles(px, ["map_no"], value, [0.02, 0.98])
    flat = F.col("q1") <= F.col("q0")
    lo = F.when(flat, F.col("lo").cast("double")).otherwise(F.col("q0"))
    hi = F.when(flat, F.col("hi").cast("double")).otherwise(F.col("q1"))
    scaled = (F.col(value) - lo) / F.greatest(hi - lo, F.lit(1e-6))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, F.lit(0.0))))
    return px.join(q, "map_no", "left").withColumn("level", level).drop("q0", "q1", "n", "lo", "hi")


def scene_relative(px: DataFrame, value: str) -> DataFrame:
    """Height above the median of the (filled) scene."""
    q = exact_percentiles(px, ["map_no"], value, [0.5]).select("map_no", F.col("q0").alias("median"))
    return px.join(q, "map_no", "left").withColumn("zscene", F.col(value) - F.col("median"))
