"""Pixel <-> cell aggregation.

A pixel table has `map_no, r, c, height, width` and one column per layer.  All
aggregates below combine on the map side, so a map that holds a third of all
pixels costs no more in one task than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import CODES, GRID, MIN_COVERAGE, UNKNOWN
from cellscape.functions.raster import cell_index, col, int_div

CELL = ("map_no", "ci", "cj")


def with_cells(px: DataFrame, grid: int = GRID) -> DataFrame:
    """A1: the painting cell of every pixel."""
    return px.withColumns(
        {"ci": cell_index("r", "height", grid), "cj": cell_index("c", "width", grid)}
    )


def cell_spine(maps: DataFrame, grid: int = GRID) -> DataFrame:
    """Every cell of every map, also those that own no pixel."""
    side = F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))
    return maps.select("map_no", F.explode(side).alias("ci")).select(
        "*", F.explode(side).alias("cj")
    )


def on_spine(spine: DataFrame, cells: DataFrame, fill: dict[str, int]) -> DataFrame:
    return spine.join(cells, list(CELL), "left").fillna(fill)


def cell_totals(px: DataFrame, value: str, grid: int = GRID) -> DataFrame:
    """A2 without the empty cells: sum, area, ground and finite counts per cell."""
    return (
        with_cells(px, grid)
        .groupBy(*CELL)
        .agg(
            F.coalesce(F.sum(value), F.lit(0)).alias("total"),
            F.count(F.lit(1)).alias("area"),
            F.count("z").alias("ground"),
            F.count(value).alias("finite"),
        )
    )


def cell_sum(px: DataFrame, maps: DataFrame, value: str, grid: int = GRID) -> DataFrame:
    """A2: totals for the whole grid, zero where a cell owns no pixel."""
    return on_spine(
        cell_spine(maps, grid),
        cell_totals(px, value, grid),
        {"total": 0, "area": 0, "ground": 0, "finite": 0},
    )


def cell_mean(px: DataFrame, value: str, grid: int = GRID, minimum: float = MIN_COVERAGE) -> DataFrame:
    """A3: mean over terrain pixels, NULL below the coverage minimum."""
    counted = F.when(F.col("z").isNotNull(), F.col(value))
    cells = (
        with_cells(px, grid)
        .groupBy(*CELL)
        .agg(F.sum(counted).alias("total"), F.count(counted).alias("n"), F.count("z").alias("ground"))
    )
    enough = (F.col("ground") > 0) & (F.col("n") >= F.lit(minimum) * F.col("ground"))
    return cells.select(
        *CELL, "n", "ground", F.when(enough, F.col("total").cast("double") / F.col("n")).alias("mean")
    )


def code_counts(code: str | Column, when: Column | None = None, prefix: str = "n") -> list[Column]:
    """One conditional count per unit; three numbers instead of a shuffle per code."""
    kept = F.lit(True) if when is None else when
    return [
        F.count_if(kept & F.coalesce(col(code) == k, F.lit(False))).alias(f"{prefix}{k}") for k in CODES
    ]


def most_common(prefix: str, otherwise: int | None) -> Column:
    """The code with the largest count, ties to the lowest code."""
    names = [f"{prefix}{k}" for k in CODES]
    best = F.greatest(*names)
    pick = F.lit(otherwise).cast("int")
    for k in reversed(CODES):
        pick = F.when(F.col(f"{prefix}{k}") == best, F.lit(k)).otherwise(pick)
    return F.when(best > 0, pick).otherwise(F.lit(otherwise).cast("int"))


def cell_majority(px: DataFrame, code: str, valid: Column | None = None, grid: int = GRID,
                  none: int = UNKNOWN) -> DataFrame:
    """A4: majority code of the pixels of each cell."""
    return (
        with_cells(px, grid)
        .groupBy(*CELL)
        .agg(*code_counts(code, valid))
        .withColumn("code", most_common("n", none))
    )


def sampled_majority(px: DataFrame, code: str, grid: int = GRID, k: int = 4) -> DataFrame:
    """A5: majority over k*k sample points of each cell, 0 where no point has a unit.

    Sample m of a side sits in pixel floor((2m+1)*size / (2*grid*k)).  Each pixel works
    out which samples fall on it, so no point table is built or joined.
    """
    n = grid * k

    def samples(position: str, size: str) -> Column:
        p, s = F.col(position).cast("bigint"), F.col(size).cast("bigint")
        first = int_div(2 * n * p - s + 2 * s - 1, 2 * s)
        last = int_div(2 * n * (p + 1) - s + 2 * s - 1, 2 * s) - 1
        return F.when(first <= last, F.sequence(first, last))

    hit = (
        px.withColumn("_i", F.explode(samples("r", "height")))
        .withColumn("_j", F.explode(samples("c", "width")))
        .select("map_no", int_div(F.col("_i"), k).alias("ci"), int_div(F.col("_j"), k).alias("cj"),
                F.col(code).alias("_code"))
    )
    return hit.groupBy(*CELL).agg(*code_counts("_code")).withColumn("code", most_common("n", 0))


def cells_to_labels(px: DataFrame, cells: DataFrame, grid: int = GRID) -> DataFrame:
    """Paint the pixels; NULL where unpainted or without terrain.

    `cells` holds at most grid*grid rows per map; Spark's own size limit decides
    whether it is broadcast.
    """
    painted = cells.where("code > 0").select(*CELL, F.col("code").alias("_code"))
    joined = with_cells(px, grid).join(painted, list(CELL), "left")
    return joined.withColumn("label", F.when(F.col("z").isNotNull(), F.col("_code"))).drop("_code")


def paintable_cells(px: DataFrame, grid: int = GRID) -> DataFrame:
    """Cells with at least one terrain pixel."""
    return with_cells(px, grid).groupBy(*CELL).agg(
        F.bool_or(F.col("z").isNotNull()).alias("paintable")
    )


def layer_stats(px: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    """Total, valid, nodata and zero counts per key and layer, in one pass."""
    wide = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(x).alias(f"{x}_valid") for x in layers],
        *[F.count_if(F.col(x) == 0).alias(f"{x}_zero") for x in layers],
    )
    rows = F.array(*[
        F.struct(F.lit(x).alias("layer"), F.col(f"{x}_valid").alias("valid"), F.col(f"{x}_zero").alias("zero"))
        for x in layers
    ])
    return wide.select(*keys, "total", F.explode(rows).alias("s")).select(
        *keys, "s.layer", "total", "s.valid", (F.col("total") - F.col("s.valid")).alias("nodata"), "s.zero"
    )


def class_counts(px: DataFrame, keys: list[str], code: str, mask: Column | None = None) -> DataFrame:
    """Pixels of each unit under a mask."""
    return px.groupBy(*keys).agg(*code_counts(code, mask))


def painted_area(labelled: DataFrame, pixel_metres: float) -> DataFrame:
    """A10: painted square kilometres per unit and the painted share of the terrain."""
    area = pixel_metres * pixel_metres / 1e6
    n = labelled.groupBy("map_no").agg(
        *code_counts("label"), F.count("label").alias("painted"), F.count("z").alias("terrain")
    )
    return n.select(
        "map_no",
        *[(F.col(f"n{k}") * F.lit(pixel_metres) * F.lit(pixel_metres) / F.lit(1e6)).alias(f"km2_{k}") for k in CODES],
        (F.col("painted").cast("double") / F.greatest(F.lit(1), F.col("terrain"))).alias("painted_frac"),
    )


def cell_counts(cells: DataFrame) -> DataFrame:
    """Painted cells by unit, approved cells by unit, hand-painted cells by certainty."""
    hand = (F.col("code") > 0) & ~F.col("accepted")
    return cells.groupBy("map_no").agg(
        *code_counts("code", prefix="cells_"),
        *code_counts("code", F.col("accepted"), prefix="accepted_"),
        *[F.count_if(hand & (F.col("conf") == k)).alias(f"confidence_{k}") for k in (1, 2, 3)],
    )


def expansion_differences(px: DataFrame, cells: DataFrame, label: str, grid: int = GRID) -> DataFrame:
    """Pixels whose stored label is not the expansion of the painting."""
    return cells_to_labels(px, cells, grid).where(~F.col("label").eqNullSafe(F.col(label)))


def decimated(px: DataFrame, value: str, side: int) -> DataFrame:
    """Longest side capped at `side`, block averages over the valid pixels."""
    longest = F.greatest("height", "width")
    def scaled(size: str) -> Column:
        return F.when(
            longest > side, F.greatest(F.lit(1).cast("bigint"), F.rint(F.col(size) * F.lit(float(side)) / longest).cast("bigint"))
        ).otherwise(F.col(size).cast("bigint"))
    small = px.withColumns({"h2": scaled("height"), "w2": scaled("width")})
    return (
        small.groupBy(
            "map_no",
            int_div(F.col("r") * F.col("h2"), F.col("height")).alias("r"),
            int_div(F.col("c") * F.col("w2"), F.col("width")).alias("c"),
            "h2", "w2",
        )
        .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        .select("map_no", "r", "c", "h2", "w2", (F.col("total").cast("double") / F.nullif("n", F.lit(0))).alias("mean"))
    )


def strided(px: DataFrame, step: int) -> DataFrame:
    """Every step-th pixel of a preview."""
    return px.where((F.col("r") % step == 0) & (F.col("c") % step == 0))
