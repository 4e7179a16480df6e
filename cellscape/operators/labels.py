"""Label state: which painting counts, how strokes fold, what a fill may touch."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import GRID, MIN_PATCH, SURE
from cellscape.operators.graph import component_sizes, grid_components
from cellscape.operators.grid import CELL
from cellscape.session import cut_lineage

# Batch functions travel with the task; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAYOUT_RANK = {"current": 0, "mirrored": 1, "legacy": 2}
META_RANK = {"catalog": 0, "legacy": 1, "mirrored": 2, "saved": 3, "draft": 4}


def _layout_rank() -> Column:
    rank = F.lit(None).cast("int")
    for name, value in LAYOUT_RANK.items():
        rank = F.when(F.col("layout") == name, value).otherwise(rank)
    return rank


def chosen_layout(artifacts: DataFrame) -> DataFrame:
    """L2: the layout whose whole set is used, per map and bucket.

    artifacts: map_no, bucket (draft|saved), layout, file, side.  A painting marks a set;
    a label raster marks a saved set too, so a newer export stops an older painting from
    coming back.  One conditional aggregate, no self join.
    """
    marker = (F.col("file") == "painting.npy") | ((F.col("bucket") == "saved") & (F.col("file") == "labels.tif"))
    return artifacts.groupBy("map_no", "bucket").agg(
        F.min(F.when(marker, _layout_rank())).alias("layout_rank")
    ).where("layout_rank is not null")


def effective_source(artifacts: DataFrame, bundles: DataFrame, grid: int = GRID) -> DataFrame:
    """L1: draft, else saved, else bundled, as a whole set: (map_no, source, layout_rank).

    A painting of the wrong shape is skipped.  A saved label raster without a painting
    suppresses the bundle.  bundles: map_no, side.
    """
    ranked = artifacts.withColumn("rank", _layout_rank()).join(chosen_layout(artifacts), ["map_no", "bucket"])
    in_set = ranked.where("rank = layout_rank")
    usable = (F.col("file") == "painting.npy") & (F.col("side") == grid)
    per_map = in_set.groupBy("map_no").agg(
        F.min(F.when(usable & (F.col("bucket") == "draft"), F.col("rank"))).alias("draft"),
        F.min(F.when(usable & (F.col("bucket") == "saved"), F.col("rank"))).alias("saved"),
        F.bool_or((F.col("bucket") == "saved") & (F.col("file") == "labels.tif")).alias("exported"),
    )
    joined = per_map.join(bundles.where(F.col("side") == grid).select("map_no", F.lit(True).alias("bundled")), "map_no", "full_outer")
    bundled = F.col("bundled") & ~F.coalesce("exported", F.lit(False))
    source = F.when(F.col("draft").isNotNull(), "draft").when(F.col("saved").isNotNull(), "saved").when(bundled, "bundled")
    return joined.select(
        "map_no", source.alias("source"), F.coalesce("draft", "saved").alias("layout_rank")
    ).where("source is not null")


def effective_painting(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells of the chosen source only; flags never come from another one."""
    return cells.join(sources.select("map_no", "source"), ["map_no", "source"], "left_semi").withColumns(
        effective_flags("code", "conf", "accepted")
    )


def effective_flags(code: str, conf: str, accepted: str) -> dict[str, Column]:
    """L3: certainty is sure unless marked, none where unpainted; approval needs paint."""
    painted = F.coalesce(F.col(code) > 0, F.lit(False))
    level = F.when(F.col(conf) > 0, F.col(conf)).otherwise(F.lit(SURE))
    return {
        conf: F.when(painted, level).otherwise(F.lit(0)).cast("int"),
        accepted: painted & F.coalesce(F.col(accepted), F.lit(False)),
    }


def merged_metadata(meta: DataFrame) -> DataFrame:
    """L4: key-wise last layer wins.  meta: map_no, layer_rank, key, value."""
    return meta.groupBy("map_no", "key").agg(F.max_by("value", "layer_rank").alias("value"))


def folded_strokes(strokes: DataFrame, paintable: DataFrame | None = None) -> DataFrame:
    """The last write per cell.  An erased cell loses its certainty and approval.

    strokes: map_no, cell, seq, code, conf, accepted.  `max_by` keeps one row per cell on
    the map side, so a cell or map that draws a third of all strokes is no hot spot.  The
    three written values travel as one number: a fixed-width buffer hashes in place where
    a struct would have to be sorted.
    """
    written = F.col("code") * 16 + F.coalesce("conf", F.lit(0)) * 2 + F.coalesce("accepted", F.lit(False)).cast("int")
    last = strokes.groupBy("map_no", "cell").agg(
        F.max_by(written.cast("int"), "seq").alias("w"), F.max("seq").alias("seq")
    )
    code, low = F.shiftright("w", 4), F.col("w").bitwiseAND(15)
    painted = code > 0
    folded = last.select(
        "map_no", "cell", "seq", code.alias("code"),
        F.when(painted, F.shiftright(low, 1)).otherwise(0).alias("conf"),
        (painted & (low.bitwiseAND(1) == 1)).alias("accepted"),
    )
    if paintable is None:
        return folded
    return folded.join(paintable, ["map_no", "cell"], "left_semi")


def approved(cells: DataFrame, suggested: DataFrame, conf: int = SURE) -> DataFrame:
    """Unpainted cells take the suggestion and are marked as approved."""
    painted = cells.where("code > 0").select(*CELL, "code", "conf", "accepted")
    fill = suggested.where("code > 0").join(painted.select(*CELL), list(CELL), "left_anti")
    return painted.unionByName(
        fill.select(*CELL, "code", F.lit(conf).alias("conf"), F.lit(True).alias("accepted"))
    )


def painting_differences(draft: DataFrame, saved: DataFrame) -> DataFrame:
    """Cells whose code, approval or certainty differs between draft and saved."""
    def state(df: DataFrame, name: str) -> DataFrame:
        return df.where("code > 0").select(*CELL, F.struct("code", "accepted", "conf").alias(name))

    both = state(draft, "draft").join(state(saved, "saved"), list(CELL), "full_outer")
    return both.where(~F.col("draft").eqNullSafe(F.col("saved")))


# -- fills -------------------------------------------------------------------


def _with_small_holes(cells: DataFrame, patch: int) -> DataFrame:
    """Adds `small`: the cell lies in a gap of the region of fewer than `patch` cells."""
    cells = cut_lineage(cells)
    gaps = grid_components(cells.withColumn("gap", F.when(~F.col("region"), F.lit(1))), "gap")
    small = component_sizes(gaps).where(F.col("cells") < patch)
    hole = gaps.join(small, ["map_no", "ri", "rj"], "left_semi").select(*CELL, F.lit(True).alias("small"))
    return cells.join(hole, list(CELL), "left").withColumn("small", F.coalesce("small", F.lit(False)))


def region_fill(suggested: DataFrame, seeds: DataFrame, patch: int = MIN_PATCH) -> DataFrame:
    """The connected region predicted as the unit of the seed cell, small holes filled.

    suggested: map_no, ci, cj, code (0 = none) for the whole grid.  seeds: map_no, ci, cj.
    """
    parts = cut_lineage(grid_components(suggested, "code"))
    seeded = (
        parts.join(seeds.select(*CELL), list(CELL), "left_semi").where("value > 0")
        .select("map_no", "ri", "rj").distinct()
    )
    region = parts.join(seeded.withColumn("region", F.lit(True)), ["map_no", "ri", "rj"], "left").select(
        *CELL, F.col("value").alias("code"), F.coalesce("region", F.lit(False)).alias("region")
    )
    touched = region.join(seeded.select("map_no").distinct(), "map_no", "left_semi")
    return _with_small_holes(touched, patch).where("(region or small) and code > 0").select(*CELL, "code")


def loop_fill(suggested: DataFrame, inside: DataFrame, unit: int, patch: int = MIN_PATCH) -> DataFrame:
    """Cells of `unit` inside the loop, specks dropped, small holes inside filled."""
    marked = suggested.join(inside.select(*CELL).withColumn("inside", F.lit(True)), list(CELL), "left").withColumn(
        "inside", F.coalesce("inside", F.lit(False))
    )
    chosen = marked.withColumn("hit", F.when(F.col("inside") & (F.col("code") == unit), F.lit(1)))
    parts = cut_lineage(grid_components(chosen, "hit"))
    big = parts.join(component_sizes(parts).where(F.col("cells") >= patch), ["map_no", "ri", "rj"], "left_semi")
    region = marked.join(big.select(*CELL, F.lit(True).alias("region")), list(CELL), "left").withColumn(
        "region", F.coalesce("region", F.lit(False))
    )
    return _with_small_holes(region, patch).where("(region or (small and inside)) and code > 0").select(*CELL, "code")


def may_fill(region: DataFrame, cells: DataFrame, paintable: DataFrame) -> DataFrame:
    """A fill never covers hand labels or missing terrain."""
    hand = cells.where("code > 0 and not accepted").select(*CELL)
    return region.join(hand, list(CELL), "left_anti").join(paintable.select(*CELL), list(CELL), "left_semi")


def widened(strokes: DataFrame, grid: int = GRID) -> DataFrame:
    """Grow a thin stroke (under a quarter of its bounding box) by one cell.

    strokes: map_no, stroke_id, ci, cj (distinct).
    """
    key = ["map_no", "stroke_id"]
    box = strokes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max("ci") - F.min("ci") + 1) * (F.max("cj") - F.min("cj") + 1)).alias("box"),
    ).select(*key, (F.col("n") * 4 < F.col("box")).alias("thin"))
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    around = F.array(*[F.struct((F.col("ci") + i).alias("ci"), (F.col("cj") + j).alias("cj")) for i, j in steps])
    here = F.array(F.struct(F.col("ci").alias("ci"), F.col("cj").alias("cj")))
    grown = strokes.join(box, key).select(*key, F.explode(F.when(F.col("thin"), around).otherwise(here)).alias("p"))
    inside = (F.col("p.ci") >= 0) & (F.col("p.cj") >= 0) & (F.col("p.ci") < grid) & (F.col("p.cj") < grid)
    return grown.where(inside).select(*key, "p.ci", "p.cj").distinct()


MOST_CELLS = 1 << 22     # cells of the bounding boxes of strokes that are worked on at once, one stroke at least


def rasterised(strokes: DataFrame, grid: int = GRID) -> DataFrame:
    """Cells a stroke passes over and cells whose centre it loops around.

    strokes: map_no, stroke_id, path ARRAY<STRUCT<x, y>> in cell coordinates; a stroke is one
    row, and its cells come out of that row.  Nothing is joined, shuffled or read twice: a
    batch of strokes is walked and scanned row by row of cells as arrays.
    """
    point = F.transform("path", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    kind = {c: strokes.schema[c].dataType.simpleString() for c in ("map_no", "stroke_id")}
    return strokes.where(F.size("path") > 0).select("map_no", "stroke_id", point.alias("path")).mapInArrow(
        _stroke_cells(grid), f"map_no {kind['map_no']}, stroke_id {kind['stroke_id']}, ci bigint, cj bigint")


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of first..last of every row, none where last is below first."""
    n = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def _walked(x, y, line, grid):
    """(stroke, ci, cj): first points, and every segment in thirds of a cell, its end included."""
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    at = np.flatnonzero(line[1:] == line[:-1])
    dx, dy = x[at + 1] - x[at], y[at + 1] - y[at]
    n = np.ceil(np.sqrt(dx * dx + dy * dy) * 3).astype(np.int64)
    s, k = _runs(np.ones(len(n), np.int64), n)
    px = np.concatenate([x[head], x[at][s] + dx[s] * k / n[s]])
    py = np.concatenate([y[head], y[at][s] + dy[s] * k / n[s]])
    who, ci, cj = np.concatenate([line[head], line[at][s]]), np.floor(py).astype(np.int64), np.floor(px).astype(np.int64)
    inside = (ci >= 0) & (cj >= 0) & (ci < grid) & (cj < grid)
    return who[inside], ci[inside], cj[inside]


def _looped(x, y, line, starts, sizes, grid):
    """(stroke, ci, cj) by the even-odd rule: the edges that a row's centre line crosses pair up into spans."""
    place = np.arange(len(x)) - starts[line]
    before = starts[line] + (place - 1) % sizes[line]
    edge = np.flatnonzero(sizes[line] > 2)
    ax, ay, bx, by = x[edge], y[edge], x[before[edge]], y[before[edge]]
    low, high = np.clip(np.floor(np.minimum(ay, by)), -1, grid).astype(np.int64), np.clip(np.floor(np.maximum(ay, by)), -1, grid).astype(np.int64)
    e, ci = _runs(np.maximum(low, 0), np.minimum(high, grid - 1))
    centre = ci + 0.5
    meets = (ay[e] > centre) != (by[e] > centre)
    e, ci, centre = e[meets], ci[meets], centre[meets]
    at = (bx[e] - ax[e]) * (centre - ay[e]) / (by[e] - ay[e]) + ax[e]
    who = line[edge][e]
    order = np.lexsort((at, ci, who))     # a closed path crosses a line an even number of times
    who, ci, at = who[order], ci[order], at[order]
    left = np.maximum(0, np.ceil(np.clip(at[0::2], -1, grid + 1) - 0.5)).astype(np.int64)
    right = np.minimum(grid, np.ceil(np.clip(at[1::2], -1, grid + 1) - 0.5)).astype(np.int64) - 1
    s, cj = _runs(left, right)
    return who[0::2][s], ci[0::2][s], cj


def _stroke_cells(grid: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            ends = path.offsets.to_numpy().astype(np.int64)
            flat = path.flatten()
            xy = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in flat.flatten()]
            x, y = (np.where(np.abs(v - np.rint(v)) < 1e-9, np.rint(v), v) for v in xy)
            ends = ends - ends[0]
            sizes = np.diff(ends)
            tall, wide = (np.minimum(np.maximum.reduceat(v, ends[:-1]) - np.minimum.reduceat(v, ends[:-1]), grid) + 1 for v in (x, y))
            weight = np.cumsum(tall * wide + 8 * sizes)
            first = 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(weight, (weight[first - 1] if first else 0) + MOST_CELLS, side="right")))
                a, b = ends[first], ends[last]
                own, starts = sizes[first:last], ends[first:last] - a
                line = np.repeat(np.arange(last - first), own)
                found = [_walked(x[a:b], y[a:b], line, grid), _looped(x[a:b], y[a:b], line, starts, own, grid)]
                who, ci, cj = (np.concatenate(v) for v in zip(*found))
                cells = np.unique((who * grid + ci) * grid + cj)
                who = pa.array(cells // (grid * grid) + first)
                yield pa.RecordBatch.from_arrays([batch.column("map_no").take(who), batch.column("stroke_id").take(who),
                                                  pa.array(cells // grid % grid), pa.array(cells % grid)], names=["map_no", "stroke_id", "ci", "cj"])
                first = last
    return run


# -- fingerprints and merging --------------------------------------------------


def fingerprint(cells: DataFrame, grid: int = GRID) -> DataFrame:
    """SHA-256 of the row-major codes, then of certainty and approval where they say
    anything.  A painting has at most grid*grid cells, so its list is bounded.  A blank painting
    has a digest too; a map without any cell has none."""
    packed = cells.groupBy("map_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("code") > 0, F.struct(
            (F.col("ci") * grid + F.col("cj")).cast("int").alias("i"),
            F.col("code").cast("int").alias("code"), F.col("conf").cast("int").alias("conf"),
            F.col("accepted").cast("int").alias("accepted"),
        )))).alias("a")
    )
    a = F.col("a")

    def gap(n: Column) -> Column:
        return F.repeat(F.lit("00"), n)

    def dense(field: str) -> Column:
        def piece(x: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(a, k - 1)["i"])
            return F.concat(gap(x["i"] - before - 1), F.lpad(F.hex(x[field]), 2, "0"))
        last = F.coalesce(F.get(a, F.size(a) - 1)["i"], F.lit(-1))      # of a blank painting: none
        return F.concat(F.array_join(F.transform(a, piece), ""), gap(F.lit(grid * grid - 1) - last))

    marked = F.exists(a, lambda x: x["conf"] != SURE)
    any_accepted = F.exists(a, lambda x: x["accepted"] == 1)
    text = F.concat(
        dense("code"),
        F.when(marked, dense("conf")).otherwise(""),
        F.when(any_accepted, F.concat(F.hex(F.lit("approved")), dense("accepted"))).otherwise(""),
    )
    return packed.select("map_no", F.sha2(F.unhex(text), 256).alias("painting_hash"))


def merged_cells(parts: DataFrame) -> DataFrame:
    """Labels of several sources on one cell: half covered and a strict majority;
    the weakest certainty and any approval stay.

    parts: map_no, ci, cj, code (NULL or 0 = unknown), conf, accepted; one row per piece.
    """
    known = F.col("code") > 0
    counts = [F.count_if(known & (F.col("code") == k)).alias(f"n{k}") for k in (1, 2, 3)]
    cells = parts.groupBy(*CELL).agg(
        *counts, F.count(F.lit(1)).alias("area"), F.count_if(known).alias("known"),
        F.max(F.when(known, F.col("conf"))).alias("conf"),
        F.bool_or(known & F.col("accepted")).alias("accepted"),
    )
    best = F.greatest("n1", "n2", "n3")
    code = F.when(F.col("n1") == best, 1).when(F.col("n2") == best, 2).otherwise(3)
    return cells.where((F.col("known") * 2 >= F.col("area")) & (best * 2 > F.col("known"))).select(
        *CELL, code.alias("code"), "conf", "accepted"
    )


def stored_flags(cells: DataFrame) -> DataFrame:
    """An all-sure certainty and an empty approval are stored as absent (NULL)."""
    painted = F.col("code") > 0
    says = cells.groupBy("map_no", "source").agg(
        F.bool_or(painted & (F.col("conf") != SURE)).alias("has_conf"),
        F.bool_or("accepted").alias("has_accepted"),
    )
    return cells.join(says, ["map_no", "source"]).withColumns({
        "conf": F.when(F.col("has_conf"), F.col("conf")),
        "accepted": F.when(F.col("has_accepted"), F.col("accepted")),
    }).drop("has_conf", "has_accepted")


def invalid_paintings(cells: DataFrame, grid: int = GRID) -> DataFrame:
    """Paintings with a wrong shape, unknown codes or flags out of range."""
    bad_code = ~F.coalesce(F.col("code").isin(0, 1, 2, 3), F.lit(False))
    bad_conf = ~F.coalesce(F.col("conf").isin(0, 1, 2, 3), F.lit(True))
    n = cells.groupBy("map_no", "source").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(bad_code).alias("bad_codes"), F.count_if(bad_conf).alias("bad_flags")
    )
    return n.withColumn("valid", (F.col("cells") == grid * grid) & (F.col("bad_codes") == 0) & (F.col("bad_flags") == 0))


def sure_manual(code: str = "code", conf: str = "conf", accepted: str = "accepted") -> Column:
    """Labelled by hand and sure."""
    return F.col(code).isin(1, 2, 3) & (F.col(conf) == SURE) & ~F.col(accepted)


def painted_maps(cells: DataFrame) -> DataFrame:
    """Maps with paint in their effective painting, and whether any of it is approved."""
    return cells.where("code > 0").groupBy("map_no").agg(F.bool_or("accepted").alias("any_accepted"))
