"""Queries over pixels and cells: scans, algebra, grid aggregation, tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions import raster as R
from cellscape.operators import distribution, grid, labels, tiles
from cellscape.plans.registry import query
from cellscape.plans.views import GRID, PX, Views
from cellscape.sources import raster as source

# -- scans -------------------------------------------------------------------


@query("S6_clean_band", """
    SELECT map_no, count(a) AS kept_read, count(b) AS kept_masked, count(*) FILTER (a>=1e30::DOUBLE) AS at_limit,
           CAST(sum(CASE WHEN a<1e30::DOUBLE THEN CAST(a AS BIGINT) END) AS BIGINT) AS total
    FROM (SELECT map_no, CASE WHEN v<>-9 AND abs(v)<=1e30 THEN v END AS a, CASE WHEN r%5<>0 AND abs(v)<1e30 THEN v END AS b
          FROM (SELECT map_no, r, CASE WHEN raw%13=0 THEN 1e30::DOUBLE WHEN raw%17=0 THEN 2e30::DOUBLE WHEN raw%19=0 THEN -9::DOUBLE
                              ELSE CAST(raw AS DOUBLE) END AS v FROM pixel)) GROUP BY 1""", "pixel")
def clean_band(v: Views):
    raw = F.col("raw")
    value = (
        F.when(raw % 13 == 0, F.lit(1e30)).when(raw % 17 == 0, F.lit(2e30)).when(raw % 19 == 0, F.lit(-9.0))
        .otherwise(raw.cast("double"))
    )
    px = v.pixel.select("map_no", value.alias("v"), (F.col("r") % 5 != 0).alias("mask"))
    both = px.select("map_no", R.clean_read("v", -9.0).alias("a"), R.clean_masked("v", "mask").alias("b"))
    return both.groupBy("map_no").agg(
        F.count("a").alias("kept_read"), F.count("b").alias("kept_masked"), F.count_if(F.col("a") >= 1e30).alias("at_limit"),
        F.sum(F.when(F.col("a") < 1e30, F.col("a")).cast("bigint")).alias("total")
    )


@query("S7_decimated_scan", """
    SELECT map_no, r*h2//height AS r, c*w2//width AS c, h2, w2, CAST(sum(z) AS DOUBLE)/nullif(count(z),0) AS mean
    FROM (SELECT *, CASE WHEN greatest(height,width)>16 THEN greatest(1,CAST(round_even(height*16.0::DOUBLE/greatest(height,width),0) AS BIGINT)) ELSE height END AS h2,
                 CASE WHEN greatest(height,width)>16 THEN greatest(1,CAST(round_even(width*16.0::DOUBLE/greatest(height,width),0) AS BIGINT)) ELSE width END AS w2 FROM pixel)
    GROUP BY 1,2,3,4,5""", "pixel")
def decimated_scan(v: Views):
    return grid.decimated(v.pixel, "z", 16)


@query("S8_strided_preview", "SELECT map_no, r, c, z FROM pixel WHERE r%4=0 AND c%4=0", "pixel")
def strided_preview(v: Views):
    return grid.strided(v.pixel, 4).select("map_no", "r", "c", "z")


@query("S9_reshape_rows", """
    SELECT map_no, r, string_agg(coalesce(CAST(z AS VARCHAR),'-'), ',' ORDER BY c) AS cells FROM pixel GROUP BY 1,2""", "pixel")
def reshape_rows(v: Views):
    rows = source.to_rows(v.pixel, "z", ["map_no", "r"])
    return rows.select("map_no", "r", F.concat_ws(",", F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("-")))).alias("cells"))


@query("S9_reshape_pixels", """
    SELECT vec_id, i-1 AS c, CAST(round(CAST(embedding[i] AS DOUBLE)*1000) AS BIGINT) AS z FROM embeddings, range(1,65) t(i)""")
def reshape_pixels(v: Views):
    px = source.from_rows(v.table("embeddings"), "embedding", ["vec_id"])
    return px.select("vec_id", "c", F.round(F.col("v").cast("double") * 1000).cast("bigint").alias("z"))


# -- predicates and algebra ----------------------------------------------------


@query("P1_masks", """
    SELECT map_no, r, c, sfs IS NOT NULL AND nac IS NOT NULL AS valid_data,
           sfs IS NOT NULL AND coalesce(image_count>0,false) AS sfs_support FROM pixel""", "pixel")
def masks(v: Views):
    return v.pixel.select("map_no", "r", "c", R.valid_data("sfs", "nac").alias("valid_data"),
                          R.sfs_support("sfs", "image_count").alias("sfs_support"))


@query("P2_exact_counts", """
    SELECT map_no, k, count(*) AS n FROM (
      SELECT map_no, v>=0 AND v=floor(v) AND CAST(CAST(v AS FLOAT) AS DOUBLE)=v AS k
      FROM (SELECT map_no, CASE WHEN raw%7=0 THEN 16777216.0::DOUBLE+abs(raw)%5 WHEN raw%7=1 THEN CAST(raw AS DOUBLE)/2 ELSE CAST(raw AS DOUBLE) END AS v FROM pixel))
    GROUP BY 1,2""", "pixel")
def exact_counts(v: Views):
    raw = F.col("raw")
    # SQL's % keeps the sign of the dividend in both engines.
    value = F.when(raw % 7 == 0, F.lit(16777216.0) + F.abs(raw) % 5).when(raw % 7 == 1, raw.cast("double") / 2).otherwise(raw.cast("double"))
    return v.pixel.select("map_no", R.exact_count(value).alias("k")).groupBy("map_no", "k").agg(F.count(F.lit(1)).alias("n"))


@query("P3_float32_overflow", """
    SELECT map_no, count(*) FILTER (WHERE abs(v)>=3.4028235677973366e38) AS overflowing, count(*) AS n
    FROM (SELECT map_no, CAST(raw AS DOUBLE)*1e35 AS v FROM pixel) GROUP BY 1""", "pixel")
def float32_overflow(v: Views):
    px = v.pixel.select("map_no", (F.col("raw").cast("double") * 1e35).alias("v"))
    return px.groupBy("map_no").agg(F.count_if(R.overflows_float32("v")).alias("overflowing"), F.count(F.lit(1)).alias("n"))


@query("P4_grid_predicate", """
    SELECT p_partkey, CASE WHEN bands<>1 THEN 'bands' WHEN NOT projected THEN 'not projected' WHEN NOT isfinite(x) THEN 'not finite'
           WHEN b<>0 THEN 'rotated' WHEN a<=0 OR e>=0 THEN 'not north-up' END AS problem,
           CASE WHEN bands<>1 THEN 'bands' WHEN NOT projected THEN 'not projected' WHEN NOT isfinite(x) THEN 'not finite'
           WHEN b<>0 THEN 'rotated' WHEN a<=0 OR e>=0 THEN 'not north-up' WHEN a<>-e THEN 'not square' END AS square_problem
    FROM (SELECT p_partkey, 1+CASE WHEN p_size=1 THEN 1 ELSE 0 END AS bands, p_size%9<>0 AS projected,
                 CASE WHEN p_size%10=3 THEN 5.0 WHEN p_size%10=4 THEN -5.0 ELSE p_size END::DOUBLE AS a,
                 CASE WHEN p_size%11=0 THEN 0.5 ELSE 0 END::DOUBLE AS b,
                 CASE WHEN p_size%13=0 THEN 'inf'::DOUBLE ELSE CAST(p_partkey AS DOUBLE) END AS x,
                 CASE WHEN p_size%10=5 THEN 5.0 ELSE -p_size END::DOUBLE AS e FROM part)""")
def grid_predicate(v: Views):
    s, zero = F.col("p_size"), F.lit(0.0)
    a = F.when(s % 10 == 3, F.lit(5.0)).when(s % 10 == 4, F.lit(-5.0)).otherwise(s.cast("double"))
    b = F.when(s % 11 == 0, F.lit(0.5)).otherwise(zero)
    x = F.when(s % 13 == 0, F.lit(float("inf"))).otherwise(F.col("p_partkey").cast("double"))
    e = F.when(s % 10 == 5, F.lit(5.0)).otherwise(-s.cast("double"))
    grids = v.table("part").select(
        "p_partkey", F.array(a, b, x, zero, e, zero).alias("transform"),
        (1 + (s == 1).cast("int")).alias("bands"), (s % 9 != 0).alias("projected"),
    )
    return grids.select("p_partkey", R.grid_problem("transform", "bands", "projected").alias("problem"),
                        R.grid_problem("transform", "bands", "projected", square=True).alias("square_problem"))


@query("P5_base_features", """
    SELECT map_no, count(slope) AS slope, count(rough) AS rough, count(svf) AS svf, count(rel_local) AS rel_local,
           count(curv) AS curv, count(svf_local) AS svf_local FROM feature GROUP BY 1""", "feature")
def base_features(v: Views):
    from cellscape.functions.constants import BASE_FEATURES
    from cellscape.operators.model import base_features as pick

    return pick(v.feature).groupBy("map_no").agg(*[F.count(n).alias(n) for n in BASE_FEATURES])


@query("P6_null_on_holes", "SELECT map_no, r, c, CASE WHEN z IS NOT NULL THEN nac END AS nac, CASE WHEN z IS NOT NULL THEN image_count END AS image_count FROM pixel", "pixel")
def null_on_holes(v: Views):
    from cellscape.operators.stencil import holes_to_null

    return holes_to_null(v.pixel, "z", ["nac", "image_count"]).select("map_no", "r", "c", "nac", "image_count")


@query("P7_paintable_cells", "SELECT map_no, ci, cj, bool_or(z IS NOT NULL) AS paintable FROM px_cell GROUP BY 1,2,3", "px_cell")
def paintable_cells(v: Views):
    return grid.paintable_cells(v.pixel, GRID)


@query("P8_painting_validity", """
    SELECT map_no, source, count(*) AS cells, count(*) FILTER (WHERE c NOT IN (0,1,2,3)) AS bad_codes,
           count(*) FILTER (WHERE conf NOT IN (0,1,2,3)) AS bad_flags,
           count(*)=64 AND count(*) FILTER (WHERE c NOT IN (0,1,2,3))=0 AND count(*) FILTER (WHERE conf NOT IN (0,1,2,3))=0 AS valid
    FROM (SELECT *, CASE WHEN map_no%3=1 AND ci=cj AND ci=7 THEN 9 ELSE code END AS c FROM cells) GROUP BY 1,2""", "cells")
def painting_validity(v: Views):
    marked = v.cells.withColumn("code", F.when((F.col("map_no") % 3 == 1) & (F.col("ci") == F.col("cj")) & (F.col("ci") == 7), 9).otherwise(F.col("code")))
    return labels.invalid_paintings(marked, GRID)


@query("P9_sure_manual", "SELECT map_no, ci, cj, code FROM paint WHERE code IN (1,2,3) AND conf=1 AND NOT accepted", "paint")
def sure_manual(v: Views):
    return v.paint.where(labels.sure_manual()).select("map_no", "ci", "cj", "code")


@query("P10_finite_terrain", """
    SELECT map_no, count(*) FILTER (WHERE slope IS NOT NULL) AS model_rows,
           count(*) FILTER (WHERE slope IS NOT NULL AND rough IS NOT NULL AND svf IS NOT NULL AND rel_local IS NOT NULL AND curv IS NOT NULL AND svf_local IS NOT NULL) AS scored_rows
    FROM feature GROUP BY 1""", "feature")
def finite_terrain(v: Views):
    from cellscape.functions.constants import BASE_FEATURES

    return v.feature.groupBy("map_no").agg(
        F.count_if(F.col("slope").isNotNull()).alias("model_rows"), F.count_if(R.all_finite(*BASE_FEATURES)).alias("scored_rows")
    )


@query("P12_robust_clip", """
    SELECT map_no, r, c, CASE WHEN nac BETWEEN lo AND hi THEN nac END AS nac FROM pixel JOIN
      (SELECT map_no, quantile_cont(nac,0.005) AS lo, quantile_cont(nac,0.995) AS hi FROM pixel GROUP BY 1) USING (map_no)""", "pixel")
def robust_clip(v: Views):
    return distribution.robust_clip(v.pixel, "nac").select("map_no", "r", "c", "nac")


@query("P13_percentile_stretch", """
    SELECT map_no, r, c, CAST(round(1e6*greatest(0,least(1,coalesce((z-lo)/greatest(hi-lo,1e-6),0)))) AS BIGINT) AS level_ppm FROM pixel JOIN
      (SELECT map_no, CASE WHEN q1<=q0 THEN mn ELSE q0 END AS lo, CASE WHEN q1<=q0 THEN mx ELSE q1 END AS hi FROM
        (SELECT map_no, quantile_cont(z,0.02) AS q0, quantile_cont(z,0.98) AS q1, min(z) AS mn, max(z) AS mx FROM pixel GROUP BY 1)) USING (map_no)""", "pixel")
def percentile_stretch(v: Views):
    return distribution.stretched(v.pixel, "z").select("map_no", "r", "c", F.round(F.col("level") * 1e6).cast("bigint").alias("level_ppm"))


@query("P14_confidence_rescale", """
    SELECT vec_id, greatest(0,least(1,coalesce((p-1.0::DOUBLE/3)/(1.0::DOUBLE-1.0::DOUBLE/3),0))) AS level
    FROM (SELECT vec_id, CASE WHEN vec_id%11=0 THEN NULL ELSE CAST(label AS DOUBLE)/9 END AS p FROM embeddings)""")
def confidence_rescale(v: Views):
    p = F.when(F.col("vec_id") % 11 != 0, F.col("label").cast("double") / 9)
    return v.table("embeddings").select("vec_id", R.rescaled_confidence(p).alias("level"))


# -- pixel <-> cell --------------------------------------------------------------


@query("A1_pixel_cell", "SELECT map_no, r, c, ci, cj FROM px_cell", "px_cell")
def pixel_cell(v: Views):
    return grid.with_cells(v.pixel, GRID).select("map_no", "r", "c", "ci", "cj")


@query("A1_pixel_cell_fine_grid", """
    SELECT map_no, ((r+1)*120-1)//height AS ci, ((c+1)*120-1)//width AS cj, count(*) AS n FROM pixel GROUP BY 1,2,3""", "pixel")
def pixel_cell_fine(v: Views):
    return grid.with_cells(v.pixel, 120).groupBy("map_no", "ci", "cj").agg(F.count(F.lit(1)).alias("n"))


@query("A2_cell_sum", """
    SELECT map_no, ci, cj, coalesce(total,0) AS total, coalesce(area,0) AS area, coalesce(ground,0) AS ground, coalesce(finite,0) AS finite
    FROM (SELECT map_no, i.v AS ci, j.v AS cj FROM shape, range(0,120) i(v), range(0,120) j(v)) LEFT JOIN
      (SELECT map_no, ((r+1)*120-1)//height AS ci, ((c+1)*120-1)//width AS cj, CAST(sum(nac) AS BIGINT) AS total, count(*) AS area, count(z) AS ground, count(nac) AS finite
       FROM pixel GROUP BY 1,2,3) USING (map_no, ci, cj)""", "pixel shape")
def cell_sum(v: Views):
    return grid.cell_sum(v.pixel, v.maps, "nac", 120)


@query("A3_cell_mean", """
    SELECT map_no, ci, cj, n, ground, CASE WHEN ground>0 AND n>=0.9::DOUBLE*ground THEN CAST(total AS DOUBLE)/n END AS mean
    FROM (SELECT map_no, ci, cj, CAST(sum(nac) FILTER (WHERE z IS NOT NULL) AS BIGINT) AS total,
                 count(nac) FILTER (WHERE z IS NOT NULL) AS n, count(z) AS ground FROM px_cell GROUP BY 1,2,3)""", "px_cell")
def cell_mean(v: Views):
    return grid.cell_mean(v.pixel, "nac", GRID)


@query("A4_cell_majority", """
    SELECT map_no, ci, cj, CASE WHEN greatest(n1,n2,n3)=0 THEN 255 WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS code
    FROM (SELECT map_no, ci, cj, count(*) FILTER (WHERE pred=1) AS n1, count(*) FILTER (WHERE pred=2) AS n2, count(*) FILTER (WHERE pred=3) AS n3
          FROM px_cell GROUP BY 1,2,3)""", "px_cell")
def cell_majority(v: Views):
    return grid.cell_majority(v.pixel, "pred", grid=GRID).select("map_no", "ci", "cj", "code")


@query("A5_sampled_majority", """
    SELECT map_no, ci, cj, CASE WHEN greatest(n1,n2,n3)=0 THEN 0 WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS code
    FROM (SELECT map_no, i.m//4 AS ci, j.m//4 AS cj, count(*) FILTER (WHERE pred=1) AS n1, count(*) FILTER (WHERE pred=2) AS n2, count(*) FILTER (WHERE pred=3) AS n3
          FROM pixel JOIN (SELECT map_no, m, CAST(floor((m+0.5::DOUBLE)*height/480) AS BIGINT) AS r FROM shape, range(0,480) s(m)) i USING (map_no, r)
          JOIN (SELECT map_no, m, CAST(floor((m+0.5::DOUBLE)*width/480) AS BIGINT) AS c FROM shape, range(0,480) s(m)) j USING (map_no, c)
          GROUP BY 1,2,3)""", "pixel shape")
def sampled_majority(v: Views):
    return grid.sampled_majority(v.pixel, "pred", 120, 4).select("map_no", "ci", "cj", "code")


@query("A6_cells_to_labels", "SELECT map_no, r, c, coalesce(label,255) AS label FROM labelled", "labelled")
def cells_to_labels(v: Views):
    return v.labelled.select("map_no", "r", "c", R.restore_missing("label", F.lit(255)).alias("label"))


@query("A7_layer_stats", """
    SELECT map_no, layer, count(*) AS total, count(v) AS valid, count(*)-count(v) AS nodata, count(*) FILTER (WHERE v=0) AS zero
    FROM (SELECT map_no, unnest(['sfs','nac','image_count']) AS layer, unnest([sfs,nac,image_count]) AS v FROM pixel) GROUP BY 1,2""", "pixel")
def layer_stats(v: Views):
    return grid.layer_stats(v.pixel, ["map_no"], ["sfs", "nac", "image_count"])


@query("A8_tile_counts", """
    SELECT map_no, r//16 AS tile_row, c//16 AS tile_col, count(sfs) AS valid_count, count(*) FILTER (WHERE sfs IS NOT NULL AND nac IS NOT NULL) AS valid_data_count,
           count(*) FILTER (WHERE sfs IS NOT NULL AND image_count>0) AS sfs_support_count FROM pixel GROUP BY 1,2,3""", "pixel")
def tile_counts(v: Views):
    return tiles.tile_counts(tiles.with_tiles(v.pixel, 16), ["map_no", "tile_row", "tile_col"])


@query("A9_class_counts", """
    SELECT map_no, count(*) FILTER (WHERE pred=1 AND nac IS NOT NULL) AS n1, count(*) FILTER (WHERE pred=2 AND nac IS NOT NULL) AS n2,
           count(*) FILTER (WHERE pred=3 AND nac IS NOT NULL) AS n3 FROM pixel GROUP BY 1""", "pixel")
def class_counts(v: Views):
    return grid.class_counts(v.pixel, ["map_no"], "pred", F.col("nac").isNotNull())


@query("A10_painted_area", """
    SELECT map_no, n1*5.0::DOUBLE*5.0::DOUBLE/1e6 AS km2_1, n2*5.0::DOUBLE*5.0::DOUBLE/1e6 AS km2_2, n3*5.0::DOUBLE*5.0::DOUBLE/1e6 AS km2_3,
           CAST(painted AS DOUBLE)/greatest(1,terrain) AS painted_frac
    FROM (SELECT map_no, count(*) FILTER (WHERE label=1) AS n1, count(*) FILTER (WHERE label=2) AS n2, count(*) FILTER (WHERE label=3) AS n3,
                 count(label) AS painted, count(z) AS terrain FROM labelled GROUP BY 1)""", "labelled")
def painted_area(v: Views):
    return grid.painted_area(v.labelled, PX)


@query("A11_cell_counts", """
    SELECT map_no, count(*) FILTER (WHERE code=1) AS cells_1, count(*) FILTER (WHERE code=2) AS cells_2, count(*) FILTER (WHERE code=3) AS cells_3,
           count(*) FILTER (WHERE code=1 AND accepted) AS accepted_1, count(*) FILTER (WHERE code=2 AND accepted) AS accepted_2, count(*) FILTER (WHERE code=3 AND accepted) AS accepted_3,
           count(*) FILTER (WHERE code>0 AND NOT accepted AND conf=1) AS confidence_1, count(*) FILTER (WHERE code>0 AND NOT accepted AND conf=2) AS confidence_2,
           count(*) FILTER (WHERE code>0 AND NOT accepted AND conf=3) AS confidence_3 FROM paint GROUP BY 1""", "paint")
def cell_counts(v: Views):
    return grid.cell_counts(v.paint)


@query("A15_expansion_check", """
    SELECT map_no, r, c FROM (SELECT map_no, r, c, label, CASE WHEN z IS NULL THEN NULL WHEN r%31=7 THEN NULL ELSE label END AS stored FROM labelled)
    WHERE label IS DISTINCT FROM stored""", "labelled")
def expansion_check(v: Views):
    stored = v.labelled.withColumn("stored", F.when(F.col("r") % 31 != 7, F.col("label"))).drop("label", "ci", "cj")
    return grid.expansion_differences(stored, v.paint, "stored", GRID).select("map_no", "r", "c")


# -- tiling ----------------------------------------------------------------------


@query("T1_tile_layout", "SELECT region, tile_id, tile_row, tile_col, row_off, col_off, tile_height, tile_width, x0, y0 FROM layout", "layout")
def tile_layout(v: Views):
    t = F.col("transform")
    return tiles.tile_layout(v.region_grid).withColumns({"x0": t[2], "y0": t[5]}).drop("transform")


@query("T2_pixel_tile", "SELECT map_no, r, c, r//24 AS tile_row, c//24 AS tile_col, r%24 AS lr, c%24 AS lc FROM pixel", "pixel")
def pixel_tile(v: Views):
    return tiles.with_tiles(v.pixel, 24).select("map_no", "r", "c", "tile_row", "tile_col", "lr", "lc")


def positioned_layout(v: Views):
    across = R.int_div(F.col("width") + 1023, 1024)
    sides = v.region_grid.select("region", across.alias("across"))
    return tiles.tile_layout(v.region_grid).join(sides, "region").withColumn(
        "position", F.col("tile_row") * F.col("across") + F.col("tile_col")
    )


def recorded_layout(v: Views):
    """The layout as a faulty writer would have recorded it."""
    n = F.col("row_off") + F.col("col_off") + F.length("region")
    return positioned_layout(v).where(n % 5 != 3).withColumns({
        "tile_id": F.when(n % 7 == 2, F.concat("tile_id", F.lit("x"))).otherwise(F.col("tile_id")),
        "tile_width": F.when(F.col("tile_row") % 3 == 2, F.col("tile_width") - 1).otherwise(F.col("tile_width")),
        "position": F.when(F.col("tile_col") == 3, F.lit(0)).otherwise(F.col("position")),
    })


RECORDED = """recorded AS (
    SELECT region, CASE WHEN (row_off+col_off+length(region))%7=2 THEN tile_id||'x' ELSE tile_id END AS tile_id, row_off, col_off, tile_height,
           CASE WHEN tile_row%3=2 THEN tile_width-1 ELSE tile_width END AS tile_width, CASE WHEN tile_col=3 THEN 0 ELSE position END AS position
    FROM layout WHERE (row_off+col_off+length(region))%5<>3)"""
LAYOUT_PROBLEMS = """layout_problem AS (
    SELECT * FROM (SELECT coalesce(a.region,b.region) AS region, coalesce(a.tile_id,b.tile_id) AS tile_id,
      CASE WHEN a.tile_id IS NULL THEN 'missing' WHEN b.tile_id IS NULL THEN 'unexpected' WHEN a.position<>b.position THEN 'order'
           WHEN a.row_off<>b.row_off OR a.col_off<>b.col_off OR a.tile_height<>b.tile_height OR a.tile_width<>b.tile_width THEN 'window' END AS problem
      FROM recorded a FULL JOIN layout b ON a.region=b.region AND a.tile_id=b.tile_id) WHERE problem IS NOT NULL)"""


@query("T3_layout_check", f"WITH {RECORDED}, {LAYOUT_PROBLEMS} SELECT region, tile_id, problem FROM layout_problem", "layout")
def layout_check(v: Views):
    return tiles.layout_differences(recorded_layout(v), positioned_layout(v))


# -- the flagship question ---------------------------------------------------------

SCORED = """scored AS (
    SELECT t.map_no, t.code AS truth, m.pred FROM paint t JOIN (
      SELECT map_no, ci, cj, CASE WHEN greatest(n1,n2,n3)=0 THEN 255 WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS pred
      FROM (SELECT map_no, ci, cj, count(*) FILTER (WHERE pred=1) AS n1, count(*) FILTER (WHERE pred=2) AS n2, count(*) FILTER (WHERE pred=3) AS n3
            FROM px_cell GROUP BY 1,2,3)) m USING (map_no, ci, cj) WHERE t.code>0)"""


def scored_cells(v: Views):
    """Painted cells next to the majority prediction of their pixels."""
    voted = grid.cell_majority(v.pixel, "pred", grid=GRID).select("map_no", "ci", "cj", F.col("code").alias("pred"))
    return v.paint.where("code > 0").select("map_no", "ci", "cj", F.col("code").alias("truth")).join(voted, ["map_no", "ci", "cj"])
