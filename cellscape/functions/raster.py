"""Column expressions over pixel values and affine grids.

A transform is an ARRAY<DOUBLE> (a, b, c, d, e, f): x = a*col + b*row + c and
y = d*col + e*row + f, with rows counted downwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellscape.functions.constants import (
    APPROVED_WEIGHT,
    CODES,
    CONFIDENCE_WEIGHT,
    MISSING_MAGNITUDE,
    SURE,
)


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def int_div(a: Column, b: Column | int) -> Column:
    """Whole-number division of non-negative integers, kept as BIGINT."""
    return F.call_function("div", a.cast("bigint"), b if isinstance(b, Column) else F.lit(b).cast("bigint"))


# -- cleaning ----------------------------------------------------------------


def clean_read(value: str | Column, nodata: float | None = None) -> Column:
    """Reader rule: NaN, the nodata value and |v| > 1e30 become NULL."""
    v = col(value)
    bad = F.isnan(v) | (F.abs(v) > MISSING_MAGNITUDE)
    if nodata is not None:
        bad = bad | (v == F.lit(nodata))
    return F.when(~bad, v)


def clean_masked(value: str | Column, mask: str | Column) -> Column:
    """Import rule: masked, non-finite and |v| >= 1e30 (inclusive) become NULL."""
    v = col(value)
    return F.when(col(mask) & ~F.isnan(v) & (F.abs(v) < MISSING_MAGNITUDE), v)


def restore_missing(value: str | Column, spelling: Column) -> Column:
    """Sinks spell the unknown as the format wants it (NaN, 0 or 255)."""
    return F.coalesce(col(value), spelling)


# -- predicates --------------------------------------------------------------


def valid_data(sfs: str | Column, nac: str | Column) -> Column:
    return col(sfs).isNotNull() & col(nac).isNotNull()


def sfs_support(sfs: str | Column, count: str | Column) -> Column:
    return col(sfs).isNotNull() & F.coalesce(col(count) > 0, F.lit(False))


def exact_count(value: str | Column) -> Column:
    """A count must be non-negative, whole and survive the trip through float32."""
    v = col(value).cast("double")
    return (v >= 0) & (v == F.floor(v)) & (v.cast("float").cast("double") == v)


def overflows_float32(value: str | Column) -> Column:
    """Finite in double precision, infinite once stored as float32."""
    v = col(value).cast("double")
    inf = F.lit(float("inf"))
    return (F.abs(v) != inf) & ~F.isnan(v) & (F.abs(v.cast("float").cast("double")) == inf)


def all_finite(*names: str) -> Column:
    """Scoring rule: a pixel counts when every feature is present."""
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull()
    return test


def grid_problem(transform: str | Column, bands: str | Column, projected: str | Column,
                 square: bool = False) -> Column:
    """Why a grid is unusable, or NULL: one band, projected, finite, north-up, unrotated."""
    t = col(transform)
    a, b, d, e = t[0], t[1], t[3], t[4]
    finite = F.forall(t, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    reason = (
        F.when(col(bands) != 1, "bands")
        .when(~col(projected), "not projected")
        .when((F.size(t) != 6) | ~finite, "not finite")
        .when((b != 0) | (d != 0), "rotated")
        .when((a <= 0) | (e >= 0), "not north-up")
    )
    if square:
        reason = reason.when(F.abs(a + e) > 1e-8 + 1e-5 * F.abs(e), "not square")
    return reason


# -- grid geometry -----------------------------------------------------------


def cell_index(position: str | Column, size: str | Column, grid: int) -> Column:
    """Painting cell of a pixel row or column under floor edges e_i = i*size//grid."""
    return int_div((col(position).cast("bigint") + 1) * F.lit(grid) - 1, col(size).cast("bigint"))


def bounds(transform: str | Column, height: str | Column, width: str | Column) -> Column:
    """Footprint (l, b, r, t) of a north-up grid."""
    t = col(transform)
    return F.struct(
        t[2].alias("l"),
        (t[5] + t[4] * col(height)).alias("b"),
        (t[2] + t[0] * col(width)).alias("r"),
        t[5].alias("t"),
    )


def shifted(transform: str | Column, row: str | Column, column: str | Column) -> Column:
    """The transform of a window that starts at (row, column) of the grid."""
    t = col(transform)
    return F.array(
        t[0], t[1], t[0] * col(column) + t[1] * col(row) + t[2],
        t[3], t[4], t[3] * col(column) + t[4] * col(row) + t[5],
    )


# -- small scales ------------------------------------------------------------


def rescaled_confidence(p: str | Column) -> Column:
    """A toss-up between the units is 0, certainty is 1, unknown is 0."""
    floor = 1.0 / len(CODES)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((col(p) - floor) / (1.0 - floor), F.lit(0.0))))


def label_weight(code: Column, confidence: Column, accepted: Column) -> Column:
    """How much a painted cell counts: an approved prediction half, else by certainty."""
    by_level = F.lit(0.0)
    level = F.coalesce(confidence, F.lit(SURE))
    for key, weight in CONFIDENCE_WEIGHT.items():
        by_level = F.when(level == key, F.lit(weight)).otherwise(by_level)
    return (
        F.when(F.coalesce(code, F.lit(0)) == 0, F.lit(0.0))
        .when(F.coalesce(accepted, F.lit(False)), F.lit(APPROVED_WEIGHT))
        .otherwise(by_level)
    )
