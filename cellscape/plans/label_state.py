"""Queries over paintings, strokes, metadata and joins on map and cell keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions import raster as R
from cellscape.operators import catalog, distribution, grid, labels, memory, overlap, regrid, sampling, tiles, training
from cellscape.plans.registry import query
from cellscape.plans.views import GRID, Views, text_id
from cellscape.session import scratch_path, stored

SOURCES = """picked AS (
    SELECT map_no, source, layout_rank FROM (
      SELECT coalesce(m.map_no,b.map_no) AS map_no, coalesce(draft,saved) AS layout_rank,
        CASE WHEN draft IS NOT NULL THEN 'draft' WHEN saved IS NOT NULL THEN 'saved' WHEN b.map_no IS NOT NULL AND NOT coalesce(exported,false) THEN 'bundled' END AS source
      FROM (SELECT map_no, min(rank) FILTER (WHERE bucket='draft' AND file='painting.npy' AND side=120) AS draft,
                   min(rank) FILTER (WHERE bucket='saved' AND file='painting.npy' AND side=120) AS saved,
                   bool_or(bucket='saved' AND file='labels.tif') AS exported
            FROM (SELECT a.*, lr, CASE layout WHEN 'current' THEN 0 WHEN 'mirrored' THEN 1 ELSE 2 END AS rank FROM artifact a JOIN
                   (SELECT map_no, bucket, min(CASE layout WHEN 'current' THEN 0 WHEN 'mirrored' THEN 1 ELSE 2 END) AS lr FROM artifact
                    WHERE file='painting.npy' OR (bucket='saved' AND file='labels.tif') GROUP BY 1,2) USING (map_no, bucket)) WHERE rank=lr GROUP BY 1) m
      FULL JOIN (SELECT map_no FROM bundle WHERE side=120) b ON m.map_no=b.map_no) WHERE source IS NOT NULL)"""


@query("L1_effective_source", f"WITH {SOURCES} SELECT map_no, source FROM picked", "artifact bundle")
def effective_source(v: Views):
    return labels.effective_source(v.artifact, v.bundle).select("map_no", "source")


@query("L1_effective_painting", """
    WITH chosen AS (SELECT map_no, arg_min(source, CASE source WHEN 'draft' THEN 0 WHEN 'saved' THEN 1 ELSE 2 END) AS source FROM cells
                    WHERE NOT (source='draft' AND map_no%3=1) AND NOT (source='saved' AND map_no%6=4) GROUP BY 1)
    SELECT map_no, source, ci, cj, code, CASE WHEN code>0 THEN CASE WHEN conf>0 THEN conf ELSE 1 END ELSE 0 END AS conf, code>0 AND accepted AS accepted
    FROM cells JOIN chosen USING (map_no, source)""", "cells")
def effective_painting(v: Views):
    gone = ((F.col("source") == "draft") & (F.col("map_no") % 3 == 1)) | ((F.col("source") == "saved") & (F.col("map_no") % 6 == 4))
    sets = v.cells.where(~gone).select("map_no", "source").distinct()
    files = sets.where("source <> 'bundled'").select(
        "map_no", F.col("source").alias("bucket"), F.lit("current").alias("layout"), F.lit("painting.npy").alias("file"), F.lit(GRID).alias("side"))
    bundles = sets.where("source = 'bundled'").select("map_no", F.lit(GRID).alias("side"))
    return labels.effective_painting(v.cells, labels.effective_source(files, bundles, GRID))


@query("L2_layout_fallback", f"WITH {SOURCES} SELECT map_no, source, layout_rank FROM picked WHERE source<>'bundled'", "artifact bundle")
def layout_fallback(v: Views):
    return labels.effective_source(v.artifact, v.bundle).where("source <> 'bundled'")


@query("L3_effective_flags", """
    SELECT map_no, cell, seq, CASE WHEN code>0 THEN CASE WHEN conf0>0 THEN conf0 ELSE 1 END ELSE 0 END AS conf, code>0 AND accepted AS accepted
    FROM (SELECT *, CASE WHEN conf=2 THEN 0 ELSE conf END AS conf0 FROM stroke)""", "stroke")
def effective_flags(v: Views):
    marked = v.stroke.withColumn("conf", F.when(F.col("conf") != 2, F.col("conf")).otherwise(0))
    return marked.withColumns(labels.effective_flags("code", "conf", "accepted")).select("map_no", "cell", "seq", "conf", "accepted")


@query("L4_metadata_merge", "SELECT map_no, key, value FROM merged", "merged")
def metadata_merge(v: Views):
    return labels.merged_metadata(v.meta)


PAINTABLE = "ok AS (SELECT map_no, ci*8+cj AS cell FROM px_cell GROUP BY 1,2 HAVING bool_or(z IS NOT NULL))"


@query("L5_stroke_fold", f"""
    WITH {PAINTABLE} SELECT map_no, cell, max(seq) AS seq, arg_max(code,seq) AS code, CASE WHEN arg_max(code,seq)>0 THEN arg_max(conf,seq) ELSE 0 END AS conf,
           arg_max(code,seq)>0 AND arg_max(accepted,seq) AS accepted
    FROM stroke JOIN ok USING (map_no, cell) GROUP BY 1,2""", "stroke px_cell")
def stroke_fold(v: Views):
    ok = grid.paintable_cells(v.pixel, GRID).where("paintable").select("map_no", (F.col("ci") * GRID + F.col("cj")).alias("cell"))
    return labels.folded_strokes(v.stroke, ok)


@query("L6_approve_prediction", """
    WITH fill AS (SELECT map_no, ci, cj, CASE WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS code FROM (
        SELECT map_no, ci, cj, count(*) FILTER (WHERE pred=1) AS n1, count(*) FILTER (WHERE pred=2) AS n2, count(*) FILTER (WHERE pred=3) AS n3
        FROM px_cell GROUP BY 1,2,3) WHERE greatest(n1,n2,n3)>0), done AS (SELECT * FROM paint WHERE code>0)
    SELECT map_no, ci, cj, code, conf, accepted FROM done
    UNION ALL SELECT map_no, ci, cj, code, 1, true FROM fill WHERE (map_no,ci,cj) NOT IN (SELECT (map_no,ci,cj) FROM done)""", "px_cell paint")
def approve_prediction(v: Views):
    return labels.approved(v.paint, grid.cell_majority(v.pixel, "pred", grid=GRID, none=0))


@query("L7_restore_diff", """
    SELECT map_no, ci, cj, a.code AS draft_code, b.code AS saved_code FROM (SELECT * FROM cells WHERE source='draft' AND code>0) a
    FULL JOIN (SELECT * FROM cells WHERE source='saved' AND code>0) b USING (map_no, ci, cj)
    WHERE a.code IS DISTINCT FROM b.code OR a.accepted IS DISTINCT FROM b.accepted OR a.conf IS DISTINCT FROM b.conf""", "cells")
def restore_diff(v: Views):
    c = v.cells
    return labels.painting_differences(c.where("source = 'draft'"), c.where("source = 'saved'")).select(
        "map_no", "ci", "cj", F.col("draft.code").alias("draft_code"), F.col("saved.code").alias("saved_code"))


LOOP = """path AS (
    SELECT event_id AS stroke_id, user_id//16 AS map_no,
      [(event_id%7)*0.9::DOUBLE, 1+(event_id*3)%7*0.8::DOUBLE, 7.5::DOUBLE-(event_id%5)*0.7::DOUBLE, (event_id*5)%8+0.25::DOUBLE] AS xs,
      [(event_id%5)*1.1::DOUBLE, 6.75::DOUBLE-(event_id%3)*0.5::DOUBLE, 1+(event_id*11)%6*0.9::DOUBLE, (event_id*7)%8+0.4::DOUBLE] AS ys FROM events)"""


def stroke_paths(v: Views):
    e = F.col("event_id")
    xs = [(e % 7) * 0.9, 1 + (e * 3) % 7 * 0.8, 7.5 - (e % 5) * 0.7, (e * 5) % 8 + 0.25]
    ys = [(e % 5) * 1.1, 6.75 - (e % 3) * 0.5, 1 + (e * 11) % 6 * 0.9, (e * 7) % 8 + 0.4]
    return v.table("events").select(
        e.alias("stroke_id"), R.int_div(F.col("user_id"), 16).alias("map_no"),
        F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in zip(xs, ys)]).alias("path"))


@query("L10_stroke_rasterise", f"""
    WITH {LOOP}, pt AS (SELECT stroke_id, map_no, i.k AS k,
        CASE WHEN abs(xs[i.k+1]-round_even(xs[i.k+1],0))<1e-9 THEN round_even(xs[i.k+1],0) ELSE xs[i.k+1] END AS x,
        CASE WHEN abs(ys[i.k+1]-round_even(ys[i.k+1],0))<1e-9 THEN round_even(ys[i.k+1],0) ELSE ys[i.k+1] END AS y FROM path, range(0,4) i(k)),
    seg AS (SELECT a.stroke_id, a.map_no, a.x AS x0, a.y AS y0, b.x-a.x AS dx, b.y-a.y AS dy, b.k AS k,
                   CAST(ceil(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))*3) AS BIGINT) AS n FROM pt a JOIN pt b ON a.stroke_id=b.stroke_id AND b.k=a.k+1),
    hit AS (SELECT map_no, stroke_id, x, y FROM pt WHERE k=0 UNION ALL
            SELECT map_no, stroke_id, x0+dx*t/n, y0+dy*t/n FROM (SELECT *, unnest(range(1,n+1)) AS t FROM seg)),
    edge2 AS (SELECT a.stroke_id, a.map_no, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM pt a JOIN pt b ON a.stroke_id=b.stroke_id AND b.k=(a.k+3)%4),
    inner_ AS (SELECT map_no, stroke_id, i.v AS ci, j.v AS cj FROM edge2, range(0,8) i(v), range(0,8) j(v)
               WHERE (ya>i.v+0.5)<>(yb>i.v+0.5) AND j.v+0.5::DOUBLE < (xb-xa)*(i.v+0.5::DOUBLE-ya)/(yb-ya)+xa GROUP BY 1,2,3,4 HAVING count(*)%2=1)
    SELECT map_no, stroke_id, CAST(floor(y) AS BIGINT) AS ci, CAST(floor(x) AS BIGINT) AS cj FROM hit WHERE x>=0 AND y>=0 AND x<8 AND y<8
    UNION SELECT map_no, stroke_id, ci, cj FROM inner_""")
def stroke_rasterise(v: Views):
    return labels.rasterised(stroke_paths(v), GRID)


@query("L11_painting_fingerprint", """
    WITH full_ AS (SELECT m.map_no, i.k AS k, coalesce(code,0) AS code, CASE WHEN code>0 THEN conf ELSE 0 END AS conf, coalesce(code>0 AND accepted,false) AS acc
      FROM (SELECT DISTINCT map_no FROM paint) m CROSS JOIN range(0,64) i(k) LEFT JOIN paint p ON p.map_no=m.map_no AND p.ci*8+p.cj=i.k)
    SELECT map_no, sha256(unhex(string_agg('0'||code,'' ORDER BY k) || CASE WHEN bool_or(conf NOT IN (0,1)) THEN string_agg('0'||conf,'' ORDER BY k) ELSE '' END
      || CASE WHEN bool_or(acc) THEN '617070726f766564'||string_agg(CASE WHEN acc THEN '01' ELSE '00' END,'' ORDER BY k) ELSE '' END)) AS painting_hash
    FROM full_ GROUP BY 1""", "paint")
def painting_fingerprint(v: Views):
    return labels.fingerprint(v.paint, GRID)


@query("L12_label_merge", """
    SELECT map_no, ci, cj, CASE WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS code, conf, accepted FROM (
      SELECT map_no, ci//2 AS ci, cj//2 AS cj, count(*) FILTER (WHERE code=1) AS n1, count(*) FILTER (WHERE code=2) AS n2, count(*) FILTER (WHERE code=3) AS n3,
             count(*) AS area, count(*) FILTER (WHERE code>0) AS known, max(conf) FILTER (WHERE code>0) AS conf, coalesce(bool_or(code>0 AND accepted),false) AS accepted
      FROM cells GROUP BY 1,2,3) WHERE known*2>=area AND greatest(n1,n2,n3)*2>known""", "cells")
def label_merge(v: Views):
    coarse = v.cells.withColumns({"ci": R.int_div(F.col("ci"), 2), "cj": R.int_div(F.col("cj"), 2)})
    return labels.merged_cells(coarse)


@query("N13_widen_stroke", """
    WITH s AS (SELECT user_id//16 AS map_no, user_id||event_type AS stroke_id, (event_id*5)%8 AS ci, (event_id*3)%8 AS cj FROM events GROUP BY ALL),
    box AS (SELECT map_no, stroke_id, count(*)*4 < (max(ci)-min(ci)+1)*(max(cj)-min(cj)+1) AS thin FROM s GROUP BY 1,2)
    SELECT DISTINCT map_no, stroke_id, ci+di AS ci, cj+dj AS cj FROM s JOIN box USING (map_no, stroke_id),
      (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) d(di,dj) WHERE (thin OR (di=0 AND dj=0)) AND ci+di BETWEEN 0 AND 7 AND cj+dj BETWEEN 0 AND 7""")
def widen_stroke(v: Views):
    e = F.col("event_id")
    strokes = v.table("events").select(
        R.int_div(F.col("user_id"), 16).alias("map_no"), F.concat(F.col("user_id").cast("string"), "event_type").alias("stroke_id"),
        (e * 5 % 8).alias("ci"), (e * 3 % 8).alias("cj")).distinct()
    return labels.widened(strokes, GRID)


@query("S19_painting_set", """
    SELECT map_no, source, ci, cj, code, CASE WHEN bool_or(code>0 AND conf<>1) OVER w THEN conf END AS conf,
           CASE WHEN bool_or(accepted) OVER w THEN accepted END AS accepted FROM cells WINDOW w AS (PARTITION BY map_no, source)""", "cells")
def painting_set(v: Views):
    return labels.stored_flags(v.cells).select("map_no", "source", "ci", "cj", "code", "conf", "accepted")


# -- regridding and alignment ----------------------------------------------------


def half_metre_grids(v: Views):
    """Source pixels of 5 m with a 15 m target that starts 7.5 m to the left and above."""
    five, zero = F.lit(5.0), F.lit(0.0)
    return v.pixel.withColumns({
        "transform": F.array(five, zero, zero, zero, -five, zero),
        "t_transform": F.array(F.lit(15.0), zero, F.lit(-7.5), zero, F.lit(-15.0), F.lit(7.5)),
        "t_height": R.int_div(F.col("height"), 3) + 2, "t_width": R.int_div(F.col("width"), 3) + 2,
    })


@query("J1_regrid_nearest", """
    SELECT s.map_no, i.k AS r, j.k AS c, p.nac FROM shape s, range(0,30) i(k), range(0,30) j(k) JOIN pixel p
      ON p.map_no=s.map_no AND p.r=CAST(floor((7.5::DOUBLE-15*(i.k+0.5::DOUBLE))/-5) AS BIGINT) AND p.c=CAST(floor((-7.5::DOUBLE+15*(j.k+0.5::DOUBLE))/5) AS BIGINT)
    WHERE i.k<s.height//3+2 AND j.k<s.width//3+2""", "shape pixel")
def regrid_nearest(v: Views):
    return regrid.regrid_nearest(half_metre_grids(v), ["map_no"], ["nac"])


@query("J1_regrid_nearest_finer", """
    SELECT map_no, r, c, nac FROM (SELECT s.map_no, i.k AS r, j.k AS c, CAST(floor((i.k+0.5::DOUBLE)*2/5+0.25) AS BIGINT) AS sr, CAST(floor((j.k+0.5::DOUBLE)*2/5+0.25) AS BIGINT) AS sc
      FROM shape s, range(0,160) i(k), range(0,160) j(k) WHERE i.k<s.height*2 AND j.k<s.width*2) t JOIN (SELECT map_no, r AS sr, c AS sc, nac FROM pixel) USING (map_no, sr, sc)""", "shape pixel")
def regrid_nearest_finer(v: Views):
    five, two, zero = F.lit(5.0), F.lit(2.0), F.lit(0.0)
    px = v.pixel.withColumns({
        "transform": F.array(five, zero, zero, zero, -five, zero),
        "t_transform": F.array(two, zero, F.lit(1.25), zero, -two, F.lit(-1.25)),
        "t_height": F.col("height") * 2, "t_width": F.col("width") * 2})
    return regrid.regrid_nearest(px, ["map_no"], ["nac"])


@query("J2_regrid_bilinear", """
    WITH t AS (SELECT s.map_no, height, width, i.k AS r, j.k AS c, (7.5::DOUBLE-15*(i.k+0.5::DOUBLE))/-5-0.5 AS u, (-7.5::DOUBLE+15*(j.k+0.5::DOUBLE))/5-0.5 AS w
               FROM shape s, range(0,30) i(k), range(0,30) j(k) WHERE i.k<s.height//3+2 AND j.k<s.width//3+2)
    SELECT map_no, t.r, t.c, CAST(round(1000*sum((1-abs(u-p.r))*(1-abs(w-p.c))*nac)/sum((1-abs(u-p.r))*(1-abs(w-p.c)))) AS BIGINT) AS nac_milli
    FROM t JOIN pixel p USING (map_no) WHERE p.nac IS NOT NULL AND abs(u-p.r)<1 AND abs(w-p.c)<1 AND u>=-0.5 AND w>=-0.5 AND u<t.height-0.5 AND w<t.width-0.5
    GROUP BY 1,2,3""", "shape pixel")
def regrid_bilinear(v: Views):
    return regrid.regrid_bilinear(half_metre_grids(v), ["map_no"], "nac").select(
        "map_no", "r", "c", F.round(F.col("nac") * 1000).cast("bigint").alias("nac_milli"))


@query("J3_layer_alignment", """
    SELECT map_no, count(*) AS pixels, count(*) FILTER (WHERE sfs IS NOT NULL AND nac IS NOT NULL) AS valid_data,
           count(*) FILTER (WHERE sfs IS NOT NULL AND image_count>0) AS sfs_support FROM pixel GROUP BY 1""", "pixel")
def layer_alignment(v: Views):
    key = ["map_no", "r", "c"]
    px = v.pixel
    sfs, nac, count = (px.where(F.col(n).isNotNull()).select(*key, n) for n in ("sfs", "nac", "image_count"))
    wide = px.select(*key).join(sfs, key, "left").join(nac, key, "left").join(count, key, "left")
    return wide.groupBy("map_no").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(R.valid_data("sfs", "nac")).alias("valid_data"),
        F.count_if(R.sfs_support("sfs", "image_count")).alias("sfs_support"))


@query("J4_companion_lookup", """
    WITH r AS (SELECT 'm'||p_partkey AS map_id, 'd'||p_partkey%7||'/m'||p_partkey AS stem, CASE WHEN p_size%3=0 THEN 'layers/'||p_partkey||'.tif' END AS layer, p_partkey, p_size FROM part),
    f AS (SELECT layer AS path FROM r WHERE p_size%2=0 AND layer IS NOT NULL UNION SELECT stem||'_nac.TIF' FROM r WHERE p_size%5<3 UNION SELECT stem||'_nac.tiff' FROM r WHERE p_size%5=1)
    SELECT map_id, CASE WHEN layer IN (SELECT path FROM f) THEN layer WHEN stem||'_nac.tiff' IN (SELECT path FROM f) THEN stem||'_nac.tiff'
                        WHEN stem||'_nac.TIF' IN (SELECT path FROM f) THEN stem||'_nac.TIF' END AS companion FROM r""")
def companion_lookup(v: Views):
    k, size = F.col("p_partkey"), F.col("p_size")
    stem = F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/m"), k.cast("string"))
    r = v.table("part").select(
        text_id("m", k).alias("map_id"), F.concat(stem, F.lit(".tif")).alias("working_dem"), stem.alias("stem"), "p_size",
        F.when(size % 3 == 0, F.concat(F.lit("layers/"), k.cast("string"), F.lit(".tif"))).alias("layer"))
    files = (
        r.where("p_size % 2 = 0 and layer is not null").select(F.col("layer").alias("path"))
        .unionByName(r.where("p_size % 5 < 3").select(F.concat("stem", F.lit("_nac.TIF")).alias("path")))
        .unionByName(r.where("p_size % 5 = 1").select(F.concat("stem", F.lit("_nac.tiff")).alias("path"))))
    return catalog.companions(r, files, "nac")


@query("J5_held_out_maps", """
    WITH named AS (SELECT map_no FROM extent WHERE map_no%47=11), box AS (SELECT l-(r-l)/2::DOUBLE AS l, b-(r-l)/2::DOUBLE AS b, r+(r-l)/2::DOUBLE AS r, t+(r-l)/2::DOUBLE AS t FROM extent JOIN named USING (map_no))
    SELECT map_no FROM named UNION SELECT e.map_no FROM extent e JOIN box ON e.l<box.r AND e.r>box.l AND e.b<box.t AND e.t>box.b""", "extent")
def held_out_maps(v: Views):
    return overlap.held_out(v.extent, v.extent.where("map_no % 47 = 11").select("map_no"))


@query("J6_footprint_exclusion", """
    WITH s AS (SELECT * FROM footprint WHERE NOT held), h AS (SELECT * FROM footprint WHERE held AND id%41<>0)
    SELECT id, 'no usable footprint' AS status FROM s WHERE id%41=0
    UNION ALL SELECT id, 'held-out map without usable footprint' FROM footprint WHERE held AND id%41=0
    UNION ALL SELECT DISTINCT s.id, 'excluded' FROM s JOIN h ON s.crs=h.crs AND s.l<=h.r AND s.r>=h.l AND s.b<=h.t AND s.t>=h.b WHERE s.id%41<>0""", "footprint")
def footprint_exclusion(v: Views):
    marked = v.footprint.withColumn("crs", F.when(F.col("id") % 41 != 0, F.col("crs")))
    return overlap.footprint_conflicts(marked.where("not held"), marked.where("held"))


@query("J7_intersections", """
    SELECT a.id, b.id AS other FROM footprint a JOIN footprint b ON a.crs=b.crs AND a.id<>b.id AND a.held AND a.l<b.r AND a.r>b.l AND a.b<b.t AND a.t>b.b""", "footprint")
def intersections(v: Views):
    a, b = v.footprint.where("held"), v.footprint.withColumnRenamed("id", "other")
    return overlap.overlap_pairs(a, b, "id", "other", False, ["crs"]).where("id <> other").select("id", "other")


@query("J8_contested_pixels", """
    SELECT r, c, min(map_no) AS first_source, max(map_no) AS last_source FROM (SELECT map_no, r+(map_no%4)*50 AS r, c+(map_no//4)*40 AS c FROM pixel)
    GROUP BY 1,2 HAVING count(DISTINCT map_no)>1""", "pixel")
def contested_pixels(v: Views):
    claims = v.pixel.select("map_no", (F.col("r") + F.col("map_no") % 4 * 50).alias("r"), (F.col("c") + R.int_div(F.col("map_no"), 4) * 40).alias("c"))
    return overlap.contested_pixels(claims, ["r", "c"], "map_no")


@query("J9_feature_transport", """
    SELECT t.map_no, t.r, t.c, CASE WHEN t.z IS NOT NULL THEN s.slope END AS slope, CASE WHEN t.z IS NOT NULL THEN s.svf END AS svf FROM pixel t
    LEFT JOIN feature s ON s.map_no=t.map_no-1 AND s.r=t.r//2 AND s.c=t.c//2+8""", "pixel feature")
def feature_transport(v: Views):
    """Each map takes its features from the map before it, at half the resolution."""
    ten, five, zero = F.lit(10.0), F.lit(5.0), F.lit(0.0)
    target = v.shape.select(F.col("map_no").alias("target"), F.col("height").alias("t_height"), F.col("width").alias("t_width"))
    src = v.feature.withColumn("target", F.col("map_no") + 1).join(target, "target").withColumns({
        "transform": F.array(ten, zero, zero, zero, -ten, zero),
        "t_transform": F.array(five, zero, F.lit(80.0), zero, -five, zero)})
    moved = regrid.regrid_nearest(src, ["target", "map_no"], ["slope", "svf"]).select(
        F.col("target").alias("map_no"), F.col("map_no").alias("source"), "r", "c", "slope", "svf")
    return training.transported(moved, v.pixel, ["slope", "svf"])


@query("J10_training_pixels", "SELECT map_no, r, c, label, w FROM teach", "teach")
def training_pixels(v: Views):
    return v.teach.select("map_no", "r", "c", "label", "w")


@query("J11_seed_paintings", """
    SELECT map_no, ci, cj, code, bucket FROM (SELECT * FROM cells WHERE source='bundled') k, (VALUES ('saved'),('draft')) b(bucket)
    WHERE map_no NOT IN (SELECT map_no FROM artifact) AND map_no IN (SELECT map_no FROM cells WHERE source='bundled' AND code>0)""".replace("FROM artifact", "FROM (SELECT CASE WHEN value>330 THEN user_id//40 END AS map_no FROM events) WHERE map_no IS NOT NULL"), "cells")
def seed_paintings(v: Views):
    bundled = v.cells.where("source = 'bundled'")
    # Events of small value left no artifact: no map.
    prior = v.table("events").select(F.when(F.col("value") > 330, R.int_div(F.col("user_id"), 40)).alias("map_no"))
    return catalog.seeded_paintings(bundled, prior).select("map_no", "ci", "cj", "code", "bucket")


@query("J12_verified_samples", """
    SELECT map_no, count(*) AS rows, CAST(sum(label) AS BIGINT) AS labels FROM teach
    WHERE map_no IN (SELECT map_no FROM merged WHERE key='verified' AND value='true') GROUP BY 1""", "teach merged")
def verified_samples(v: Views):
    kept = training.of_verified(v.teach, labels.merged_metadata(v.meta))
    return kept.groupBy("map_no").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("labels"))


@query("J13_painted_maps", "SELECT map_no, bool_or(accepted) AS any_accepted FROM paint WHERE code>0 GROUP BY 1", "paint")
def painted_maps(v: Views):
    return labels.painted_maps(v.paint)


@query("J14_changed_inputs", """
    WITH st AS (SELECT map_no, source, string_agg(ci||','||cj||','||code||','||conf, ';' ORDER BY ci, cj) AS h, count(*) AS n FROM cells GROUP BY 1,2),
    a AS (SELECT * FROM st WHERE source='draft' AND map_no%7<>3), b AS (SELECT map_no, CASE WHEN map_no%2=0 THEN d.h ELSE s.h END AS h, s.n FROM
          (SELECT * FROM st WHERE source='saved') s JOIN (SELECT * FROM st WHERE source='draft') d USING (map_no) WHERE map_no%7<>5)
    SELECT coalesce(a.map_no,b.map_no) AS map_no, CASE WHEN b.map_no IS NULL THEN 'added' WHEN a.map_no IS NULL THEN 'removed' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.map_no=b.map_no WHERE a.h IS DISTINCT FROM b.h""", "cells")
def changed_inputs(v: Views):
    c = v.cells
    def state(source: str):
        return labels.fingerprint(c.where(F.col("source") == source).withColumn("code", F.col("code") + 1), GRID)
    draft, saved = state("draft"), state("saved").withColumnRenamed("painting_hash", "saved_hash")
    current = draft.where("map_no % 7 <> 3")
    recorded = saved.join(draft, "map_no").where("map_no % 7 <> 5").select(
        "map_no", F.when(F.col("map_no") % 2 == 0, F.col("painting_hash")).otherwise(F.col("saved_hash")).alias("painting_hash"))
    return training.changed_inputs(current, recorded, ["painting_hash"])


# Contents of parts as rasters; every part but the first takes features from the part a third as high.
DEEP = 9     # levels of that graph, more than the given tables have


def _revision_sql(content: str) -> tuple[str, str]:
    steps = [f"r0 AS (SELECT p_partkey AS map_no, sha256({content}) AS rev FROM part WHERE p_partkey<3)"]
    for k in range(1, DEEP + 4):
        steps.append(f"r{k} AS (SELECT p_partkey AS map_no, sha256({content}||'|'||p_partkey//3||':'||rev) AS rev FROM part JOIN r{k - 1} ON r{k - 1}.map_no=p_partkey//3 WHERE p_partkey>=3)")
    return ",\n    ".join(steps), " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(DEEP + 4))


_NOW, _NOW_ALL = _revision_sql("p_name||CASE WHEN p_partkey IN (1, 17) THEN 'edited' ELSE '' END")
_THEN, _THEN_ALL = _revision_sql("p_name")


@query("J14_changed_sources", f"""
    WITH now_ AS (WITH {_NOW} {_NOW_ALL}), then_ AS (WITH {_THEN} {_THEN_ALL})
    SELECT map_no, 'changed' AS status FROM now_ a JOIN then_ b USING (map_no) WHERE a.rev<>b.rev""")
def changed_sources(v: Views):
    """Two edited rasters: every map above them, however far, is to be read again."""
    part, k = v.table("part"), F.col("p_partkey")
    links = part.where(k >= 3).select(k.alias("map_no"), R.int_div(k, 3).alias("source"))
    graded = memory.graded_sources(part.select(k.alias("map_no")), links)      # one graph for both states

    def inputs(content):
        rev = memory.source_revisions(part.select(k.alias("map_no"), content.alias("hash")), links, graded)
        return rev.select("map_no", F.lit("same").alias("painting_hash"), F.col("revision").alias("source_revision"))

    edited = F.concat("p_name", F.when(k.isin(1, 17), "edited").otherwise(""))
    return memory.changed_training(inputs(edited), inputs(F.col("p_name")), "schema 1", "schema 1")


MEMORY_MAPS = """vm AS (SELECT DISTINCT map_no FROM merged WHERE key='verified' AND value='true'), old_ AS (SELECT DISTINCT map_no FROM teach),
    ask AS (SELECT map_no FROM old_ WHERE map_no%3<>0 UNION SELECT 500), fresh_ AS (SELECT DISTINCT map_no FROM teach WHERE map_no%3=1),
    st AS (SELECT map_no, a.map_no IS NOT NULL AS asked, o.map_no IS NOT NULL AS old, f.map_no IS NOT NULL AS fresh, v.map_no IS NOT NULL AS ok, map_no=1 AS held, map_no//3=0 AS shut
      FROM (SELECT map_no FROM old_ UNION SELECT map_no FROM ask) LEFT JOIN ask a USING (map_no) LEFT JOIN old_ o USING (map_no) LEFT JOIN fresh_ f USING (map_no) LEFT JOIN vm v USING (map_no))"""


@query("M6_incremental_memory", f"""WITH {MEMORY_MAPS},
    told AS (SELECT map_no, CASE WHEN asked AND held THEN 'refused: held out' WHEN asked AND NOT ok THEN 'refused: not verified' WHEN asked AND fresh AND shut THEN 'refused: excluded geography'
      WHEN asked AND NOT fresh THEN 'forgotten' WHEN asked AND old THEN 'replaced' WHEN asked THEN 'added' WHEN held OR shut THEN 'dropped: excluded' WHEN NOT ok THEN 'dropped: not verified' ELSE 'kept' END AS status FROM st)
    SELECT t.map_no, t.status, count(x.map_no) AS rows FROM told t LEFT JOIN teach x ON x.map_no=t.map_no AND (t.status='kept' OR t.status='replaced' AND x.z IS NOT NULL) GROUP BY 1, 2""", "teach merged")
def incremental_memory(v: Views):
    """Memory of all paintings; a third of the maps is sampled anew, a third cleared, map 1 is held out with its group of three."""
    path = scratch_path(v.spark, "memory")
    samples = stored(v.teach.select("map_no", "r", "c", "z", "label", "w"), "teach")     # read by every step below
    nothing = v.spark.createDataFrame([], "map_no bigint, version int")
    memory.publish(path, samples, nothing)
    every = stored(samples.select("map_no").distinct(), "every")
    m = F.col("map_no")
    asked = every.where("map_no % 3 <> 0").unionByName(v.spark.createDataFrame([(500,)], "map_no bigint"))
    fresh = samples.where("map_no % 3 = 1 and z is not null")
    verified = labels.merged_metadata(v.meta).where("key = 'verified' and value = 'true'").select("map_no")
    # The held-out map belongs to its group whether it is painted or not.
    known = every.unionByName(v.spark.createDataFrame([(500,), (1,)], "map_no bigint")).distinct()
    left = m.cast("double") * 10
    told = memory.updated(path, asked, fresh, verified, v.spark.createDataFrame([(1,)], "map_no bigint"), known.select("map_no", R.int_div(m, 3).alias("grp")),
                          v.spark.createDataFrame([], "map_no bigint, tile bigint"),
                          known.select("map_no", F.lit("moon").alias("crs"), left.alias("l"), F.lit(0.0).alias("b"), (left + 5).alias("r"), F.lit(5.0).alias("t")))
    kept = memory.memory(v.spark, path).groupBy("map_no").agg(F.count(F.lit(1)).alias("rows"))
    return told.join(kept.withColumn("map_no", m.cast("bigint")), "map_no", "left").select("map_no", "status", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("J15_disagreement", "SELECT map_no, r, c, label, pred FROM labelled WHERE pred IN (1,2,3) AND label IN (1,2,3) AND pred<>label", "labelled")
def disagreement(v: Views):
    return catalog.disagreement(v.labelled, "pred", "label").select("map_no", "r", "c", "label", "pred")


@query("J16_map_lookup", """
    WITH rec AS (SELECT 'm'||p_partkey||CASE WHEN p_size%4=0 THEN '.v2' ELSE '' END AS map_id, 'site_'||p_partkey%13 AS site, CASE WHEN p_size%3=0 THEN p_brand END AS grp FROM part),
    ask AS (SELECT DISTINCT 'm'||l_partkey||CASE l_linenumber%3 WHEN 0 THEN '' WHEN 1 THEN '.v2' ELSE '.tif' END AS name FROM lineitem)
    SELECT name, coalesce(a.map_id,b.map_id) AS map_id, CASE WHEN a.map_id IS NOT NULL THEN coalesce(a.grp,a.site) ELSE coalesce(b.grp,b.site) END AS site_group
    FROM ask LEFT JOIN rec a ON a.map_id=ask.name LEFT JOIN rec b ON b.map_id=regexp_replace(ask.name,'^(.+)\\.[^.]*$','\\1')""")
def map_lookup(v: Views):
    k = F.col("p_partkey")
    rec = v.table("part").select(
        F.concat(text_id("m", k), F.when(F.col("p_size") % 4 == 0, ".v2").otherwise("")).alias("map_id"),
        text_id("site_", k % 13).alias("site"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("grp"))
    n = F.col("l_linenumber") % 3
    ask = v.table("lineitem").select(
        F.concat(text_id("m", F.col("l_partkey")), F.when(n == 0, "").when(n == 1, ".v2").otherwise(".tif")).alias("name")).distinct()
    return catalog.looked_up(ask, rec)


@query("J17_named_subset", "SELECT position, map_no FROM (SELECT o_orderkey AS position, o_custkey*5 AS map_no FROM orders) WHERE map_no IN (SELECT c_custkey FROM customer)")
def named_subset(v: Views):
    names = v.table("orders").select(F.col("o_orderkey").alias("position"), (F.col("o_custkey") * 5).alias("map_no"))
    return catalog.listed(names, v.table("customer").select(F.col("c_custkey").alias("map_no"))).select("position", "map_no")


LISTING = """listing AS (
    SELECT m.map_no, section, coalesce(v.map_no IS NOT NULL,false) AS verified, coalesce(p.map_no IS NOT NULL,false) AS painted, coalesce(s.map_no IS NOT NULL,false) AS saved,
           coalesce(e.map_no IS NOT NULL,false) AS exported, coalesce(p.map_no IS NOT NULL,false) OR coalesce(e.map_no IS NOT NULL,false) AS labelled
    FROM (SELECT DISTINCT user_id AS map_no, 'section '||user_id%4 AS section FROM events) m
    LEFT JOIN (SELECT map_no FROM merged WHERE key='verified' AND value='true') v ON v.map_no=m.map_no
    LEFT JOIN (SELECT DISTINCT map_no FROM paint WHERE code>0) p ON p.map_no=m.map_no
    LEFT JOIN (SELECT DISTINCT map_no FROM cells WHERE source='saved' AND code>0) s ON s.map_no=m.map_no
    LEFT JOIN (SELECT DISTINCT user_id AS map_no FROM events WHERE event_type='click' AND event_id%9=0) e ON e.map_no=m.map_no)"""


def listing(v: Views):
    ev = v.table("events")
    maps = ev.select(F.col("user_id").alias("map_no"), text_id("section ", F.col("user_id") % 4).alias("section")).distinct()
    exports = ev.where("event_type = 'click' and event_id % 9 = 0").select(F.col("user_id").alias("map_no"))
    saved = v.cells.where("source = 'saved' and code > 0")
    return catalog.map_listing(maps, labels.painted_maps(v.paint), saved, labels.merged_metadata(v.meta), exports)


@query("J18_map_listing", f"WITH {LISTING} SELECT * FROM listing", "merged paint cells")
def map_listing(v: Views):
    return listing(v)


@query("P11_gallery_filter", f"WITH {LISTING} SELECT map_no, section FROM listing WHERE section='section 1' AND saved AND NOT verified", "merged paint cells")
def gallery_filter(v: Views):
    return catalog.gallery(listing(v), "section 1", "saved-unverified").select("map_no", "section")


@query("A13_has_labels", "SELECT map_no, map_no IN (SELECT map_no FROM cells WHERE source='saved' AND code IN (1,2,3)) AS has_labels FROM (SELECT DISTINCT user_id AS map_no FROM events)", "cells")
def has_labels(v: Views):
    maps = v.table("events").select(F.col("user_id").alias("map_no")).distinct()
    return catalog.with_labels(maps, v.cells.where("source = 'saved'"))


@query("A14_selection_counts", f"WITH {LISTING} SELECT count(*) AS maps, count(*) FILTER (WHERE verified) AS verified FROM listing", "merged paint cells")
def selection_counts(v: Views):
    return catalog.selection_counts(listing(v))


@query("A16_memory_summary", """
    WITH t AS (SELECT map_no, count(*) AS n FROM teach GROUP BY 1)
    SELECT count(*) AS tiles, count(DISTINCT map_no//2) AS map_groups, count(DISTINCT map_no%3) AS geography_groups, CAST(sum(n) AS BIGINT) AS sampled_pixels FROM t""", "teach")
def memory_summary(v: Views):
    maps = v.maps.select("map_no", R.int_div(F.col("map_no"), 2).cast("string").alias("map_group"), (F.col("map_no") % 3).cast("string").alias("geography"))
    return training.memory_summary(v.teach, maps)


@query("J19_footprints", """
    WITH cur AS (SELECT region, x0 AS l, y0-5*height AS b, x0+5*width AS r, y0 AS t FROM region_grid WHERE height%3<>0),
    old AS (SELECT 'reg'||s_suppkey AS region, CAST(l AS DOUBLE) AS l, CAST(b AS DOUBLE) AS b, CAST(r AS DOUBLE) AS r, CAST(t AS DOUBLE) AS t FROM extent JOIN supplier ON s_suppkey=map_no WHERE s_nationkey%2=0)
    SELECT coalesce(c.region,o.region) AS map_no, CASE WHEN c.region IS NOT NULL THEN 'own' ELSE 'old' END AS crs, coalesce(c.l,o.l) AS l, coalesce(c.b,o.b) AS b, coalesce(c.r,o.r) AS r, coalesce(c.t,o.t) AS t,
           CASE WHEN c.region IS NOT NULL THEN 'current' ELSE 'remembered' END AS source FROM cur c FULL JOIN old o ON c.region=o.region""", "region_grid extent")
def footprints(v: Views):
    current = v.region_grid.where("height % 3 <> 0").select(F.col("region").alias("map_no"), F.lit("own").alias("crs"), "height", "width", "transform")
    even = v.table("supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("map_no"))
    old = v.extent.join(even, "map_no", "left_semi").select(
        text_id("reg", F.col("map_no")).alias("map_no"), F.lit("old").alias("crs"), *[F.col(x).cast("double").alias(x) for x in "lbrt"])
    return training.footprints(current, old)


# -- samples, pages, order ---------------------------------------------------------


@query("R1_stratified_sample", """
    SELECT map_no, r, c, label, w FROM (SELECT t.*, row_number() OVER (PARTITION BY t.map_no, label ORDER BY md5(t.map_no||'|'||t.r||'|'||t.c||'|0')) AS k
      FROM teach t JOIN feature f ON f.map_no=t.map_no AND f.r=t.r AND f.c=t.c WHERE w>0 AND f.slope IS NOT NULL) WHERE k<=300""", "teach feature")
def stratified_sample(v: Views):
    return sampling.stratified(v.teach, 300).select("map_no", "r", "c", "label", "w")


@query("R1_stratified_sample_full", """
    SELECT map_no, r, c, label, w FROM (SELECT t.*, row_number() OVER (PARTITION BY t.map_no, label ORDER BY md5(t.map_no||'|'||t.r||'|'||t.c||'|0')) AS k
      FROM teach t WHERE w>0 AND z IS NOT NULL) WHERE k<=1200""", "teach")
def stratified_sample_full(v: Views):
    """A limit beyond what Spark ranks before the shuffle: the sliced form."""
    return sampling.stratified(v.teach, 1200).select("map_no", "r", "c", "label", "w")


@query("R2_per_cell_sample", """
    SELECT map_no, r, c, ci, cj, code FROM (SELECT p.map_no, p.r, p.c, ci, cj, code, row_number() OVER (PARTITION BY p.map_no, ci, cj ORDER BY md5(p.map_no||'|'||p.r||'|'||p.c||'|0')) AS k
      FROM px_cell p JOIN paint USING (map_no, ci, cj) WHERE code>0 AND z IS NOT NULL) WHERE k<=12""", "px_cell paint")
def per_cell_sample(v: Views):
    return sampling.per_cell(v.feature, v.paint, GRID, 12).select("map_no", "r", "c", "ci", "cj", "code")


@query("R3_balanced_cap", """
    SELECT map_no, r, c, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(map_no||'|'||r||'|'||c||'|0')) AS k, count(*) OVER () AS total FROM teach)
    WHERE total<=6000 OR k<=6000//(SELECT count(DISTINCT label) FROM teach)""", "teach")
def balanced_cap(v: Views):
    return sampling.balanced_cap(v.teach, 6000).select("map_no", "r", "c", "label")


@query("R3_balanced_cap_small", "SELECT map_no, r, c, label FROM teach", "teach")
def balanced_cap_small(v: Views):
    """Below the limit every row stays."""
    return sampling.balanced_cap(v.teach, 10**9).select("map_no", "r", "c", "label")


@query("R4_gallery_page", f"WITH {LISTING} SELECT map_no, section FROM listing ORDER BY section, map_no LIMIT 24 OFFSET 24", "merged paint cells")
def gallery_page(v: Views):
    return sampling.page(listing(v).select("map_no", "section"), ["section", "map_no"], 2)


@query("R4_sections", "SELECT DISTINCT 'section '||user_id%4 AS section FROM events")
def section_list(v: Views):
    return sampling.sections(listing(v))


@query("R5_ordered_dedupe", "SELECT user_id AS name, min(event_id) AS position FROM events GROUP BY 1")
def ordered_dedupe(v: Views):
    names = v.table("events").select(F.col("user_id").alias("name"), F.col("event_id").alias("position"))
    return sampling.first_positions(names, "name", "position")


@query("T5_nominal_placement", """
    WITH b AS (SELECT map_no, section, height, width, x, y, greatest(height,width) AS side FROM placed),
    peer AS (SELECT DISTINCT section, height AS s, (x%height+height)%height AS px, (y%height+height)%height AS py FROM b WHERE height=width),
    fit AS (SELECT map_no, s, ((x-px)%s+s)%s AS co, ((y-py)%s+s)%s AS ro, height, width FROM b JOIN peer USING (section) WHERE s>=side),
    best AS (SELECT DISTINCT ON (map_no) map_no, s, ro, co FROM fit WHERE co+width<=s AND ro+height<=s ORDER BY map_no, s DESC, ro, co)
    SELECT b.map_no, coalesce(s,side) AS side, coalesce(ro,0) AS row_in, coalesce(co,0) AS col_in,
           CAST(coalesce(co,0) AS DOUBLE)/coalesce(s,side) AS x, CAST(coalesce(ro,0) AS DOUBLE)/coalesce(s,side) AS y, CAST(width AS DOUBLE)/coalesce(s,side) AS w, CAST(height AS DOUBLE)/coalesce(s,side) AS h
    FROM b LEFT JOIN best USING (map_no)""".replace("WITH b AS", """WITH placed AS (SELECT c_custkey AS map_no, 's'||c_nationkey AS section,
        CASE WHEN c_custkey%5=0 THEN 64 WHEN c_custkey%17=0 THEN 128 ELSE 1+c_custkey%64 END AS height, CASE WHEN c_custkey%5=0 THEN 64 WHEN c_custkey%17=0 THEN 128 ELSE 1+(c_custkey*7)%64 END AS width,
        (c_custkey%9)*64+c_custkey%3*8 AS x, (c_custkey%11)*64+CASE WHEN c_custkey%5=0 THEN 0 ELSE c_custkey%2*16 END AS y FROM customer), b AS"""))
def nominal_placement(v: Views):
    k = F.col("c_custkey")
    five, zero = F.lit(5.0), F.lit(0.0)
    x = (k % 9) * 64 + k % 3 * 8
    y = (k % 11) * 64 + F.when(k % 5 == 0, 0).otherwise(k % 2 * 16)
    maps = v.table("customer").select(
        k.alias("map_no"), text_id("s", F.col("c_nationkey")).alias("section"), F.lit("moon").alias("crs"),
        F.when(k % 5 == 0, 64).when(k % 17 == 0, 128).otherwise(1 + k % 64).alias("height"),
        F.when(k % 5 == 0, 64).when(k % 17 == 0, 128).otherwise(1 + k * 7 % 64).alias("width"),
        F.array(five, zero, (x * 5).cast("double"), zero, -five, (y * -5).cast("double")).alias("transform"))
    return tiles.nominal_placement(maps)


@query("N10_scene_relative", "SELECT map_no, r, c, CAST(raw AS DOUBLE)-(median(raw) OVER (PARTITION BY map_no)) AS zscene FROM pixel", "pixel")
def scene_relative(v: Views):
    return distribution.scene_relative(v.pixel, "raw").select("map_no", "r", "c", "zscene")
