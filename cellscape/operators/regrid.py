"""Moving values between grids.

Every operator starts from the source pixel and works out which target pixels it
feeds.  Nothing is joined to a generated target table, pixels that feed nothing are
dropped before the shuffle, and partial sums combine on the map side.

A target grid is columns on the source rows: t_height, t_width and, for affine
grids, t_transform next to the source's own transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.raster import int_div


def _clipped(first: Column, last: Column, size: Column) -> Column:
    lo = F.greatest(first, F.lit(0)).cast("bigint")
    hi = F.least(last, size - 1).cast("bigint")
    return F.when(lo <= hi, F.sequence(lo, hi))


def _centre(index: Column, transform: Column, scale: int, origin: int) -> Column:
    return transform[origin] + (index + F.lit(0.5)) * transform[scale]


SLACK = 1e-3    # of a pixel: rounding stays below it while positions are within 1e11 pixels of the origin


def _axis_nearest(px: DataFrame, out: str, position: str, size: str, scale: int, origin: int) -> DataFrame:
    """Target indices of one axis whose centre lies in this source pixel."""
    s, t = F.col("transform"), F.col("t_transform")
    edge0 = s[origin] + F.col(position) * s[scale]
    edge1 = s[origin] + (F.col(position) + 1) * s[scale]
    u0, u1 = (edge0 - t[origin]) / t[scale] - 0.5, (edge1 - t[origin]) / t[scale] - 0.5
    guess = _clipped(F.ceil(F.least(u0, u1) - SLACK), F.floor(F.greatest(u0, u1) + SLACK), F.col(size))
    # The candidate range is a little wider than the pixel; the forward rule decides.
    exact = F.floor((_centre(F.col(out), t, scale, origin) - s[origin]) / s[scale]) == F.col(position)
    return px.withColumn(out, F.explode(guess)).where(exact)


def regrid_nearest(px: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Value of the source pixel under each target centre; uncovered targets are absent.

    Each target centre lies in at most one source pixel, so this needs no shuffle.
    """
    rows = _axis_nearest(px, "tr", "r", "t_height", 4, 5)
    both = _axis_nearest(rows, "tc", "c", "t_width", 0, 2)
    return both.select(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"), *values)


def _axis_linear(px: DataFrame, out: str, position: str, size: str, scale: int, origin: int) -> DataFrame:
    s, t = F.col("transform"), F.col("t_transform")
    ratio = s[scale] / t[scale]
    near = (s[origin] + (F.col(position) + 0.5) * s[scale] - t[origin]) / t[scale] - 0.5
    guess = _clipped(F.floor(near - F.abs(ratio)), F.ceil(near + F.abs(ratio)), F.col(size))
    u = (_centre(F.col(out), t, scale, origin) - s[origin]) / s[scale] - 0.5
    weight = 1 - F.abs(u - F.col(position))
    inside = (u >= -0.5) & (u < F.col(f"s_{size}") - 0.5)
    return (
        px.withColumn(out, F.explode(guess))
        .withColumn(f"{out}_w", weight)
        .where((F.col(f"{out}_w") > 0) & inside)
    )


def regrid_bilinear(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bilinear regrid; missing neighbours drop out and the rest is renormalised."""
    src = px.withColumns({"s_t_height": F.col("height"), "s_t_width": F.col("width")})
    rows = _axis_linear(src.where(F.col(value).isNotNull()), "tr", "r", "t_height", 4, 5)
    both = _axis_linear(rows, "tc", "c", "t_width", 0, 2)
    w = F.col("tr_w") * F.col("tc_w")
    return (
        both.groupBy(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"))
        .agg(F.sum(w * F.col(value)).alias("_v"), F.sum(w).alias("_w"))
        .select(*keys, "r", "c", (F.col("_v") / F.col("_w")).alias(value))
    )


def _axis_zoom(px: DataFrame, out: str, position: str, size: str, target: str) -> DataFrame:
    """End-aligned linear zoom: target i reads source coordinate i*(size-1)/(target-1)."""
    n, m, p = F.col(size), F.col(target), F.col(position)
    at = F.when(m > 1, F.col(out) * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
    per = F.when(n > 1, (m - 1) / (n - 1))
    lo = F.when(n > 1, F.floor((p - 1) * per)).otherwise(0)
    hi = F.when(n > 1, F.ceil((p + 1) * per)).otherwise(m - 1)
    return (
        px.withColumn(out, F.explode(_clipped(lo, hi, m)))
        .withColumn(f"{out}_w", 1 - F.abs(at - p))
        .where(F.col(f"{out}_w") > 0)
    )


def zoom(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Order-1 zoom to t_height x t_width with aligned end points."""
    rows = _axis_zoom(px.where(F.col(value).isNotNull()), "tr", "r", "height", "t_height")
    both = _axis_zoom(rows, "tc", "c", "width", "t_width")
    return (
        both.groupBy(*keys, F.col("t_height").alias("height"), F.col("t_width").alias("width"),
                     F.col("tr").alias("r"), F.col("tc").alias("c"))
        .agg(F.sum(F.col("tr_w") * F.col("tc_w") * F.col(value)).alias(value))
    )


def _axis_triangle(px: DataFrame, out: str, position: str, size: str, target: str) -> DataFrame:
    """Centre-aligned triangle filter, widened when shrinking (picture resize rule)."""
    n, m, p = F.col(size).cast("double"), F.col(target).cast("double"), F.col(position)
    scale = n / m
    support = F.greatest(scale, F.lit(1.0))
    guess = _clipped(F.floor((p - support) / scale - 1), F.ceil((p + 1 + support) / scale + 1), F.col(target))
    centre = (F.col(out) + 0.5) * scale
    first = F.greatest(F.lit(0), F.floor(centre - support + 0.5))
    last = F.least(n, F.floor(centre + support + 0.5))
    weight = 1 - F.abs(p - centre + 0.5) / support
    return (
        px.withColumn(out, F.explode(guess))
        .where((p >= first) & (p < last))
        .withColumn(f"{out}_w", weight)
        .where(F.col(f"{out}_w") > 0)
    )


def resized(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Float map on another shape; NULL where the nearest source pixel is missing."""
    rows = _axis_triangle(px, "tr", "r", "height", "t_height")
    both = _axis_triangle(rows, "tc", "c", "width", "t_width")
    w = F.col("tr_w") * F.col("tc_w")
    nearest = (
        (int_div((2 * F.col("tr") + 1) * F.col("height"), 2 * F.col("t_height")) == F.col("r"))
        & (int_div((2 * F.col("tc") + 1) * F.col("width"), 2 * F.col("t_width")) == F.col("c"))
    )
    return (
        both.groupBy(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"))
        .agg(
            F.sum(w * F.coalesce(F.col(value), F.lit(0.0))).alias("_v"),
            F.sum(w).alias("_w"),
            F.bool_or(nearest & F.col(value).isNull()).alias("_gone"),
        )
        .select(*keys, "r", "c", F.when(~F.col("_gone"), F.col("_v") / F.col("_w")).alias(value))
    )
