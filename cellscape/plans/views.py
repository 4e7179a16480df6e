"""Rasters, paintings, strokes and catalogs derived from the given tables.

Every view reads its whole table.  The SQL text of a view is the same rule for another
engine, used to check results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.functions.raster import int_div
from cellscape.operators.labels import folded_strokes
from cellscape.session import stored

SIDE = 64   # raster columns, and rows of a full map
GRID = 8    # painting cells per side in the registered queries
PX = 5.0    # metres per pixel

SQL_VIEWS: dict[str, tuple[str, str]] = {
    "shape": ("", "SELECT vec_id//64 AS map_no, max(vec_id%64)+1 AS height, CAST(64 AS BIGINT) AS width FROM embeddings GROUP BY 1"),
    "pixel": ("shape", """
        SELECT map_no, r, c, height, width, raw, z, z AS sfs,
               CASE WHEN (r*5+c*3)%17=0 THEN NULL ELSE raw*2+1000 END AS nac,
               CASE WHEN (r*3+c)%23=0 THEN NULL ELSE abs(raw+r+c)%4 END AS image_count,
               CASE WHEN z IS NULL THEN NULL ELSE 1+abs(raw+7*(r//8)+3*(c//8))%3 END AS pred
        FROM (SELECT map_no, r, c, raw,
                     CASE WHEN (r*7+c*13)%29=0 OR (map_no%8=3 AND r<20 AND c<20) THEN NULL ELSE raw END AS z
              FROM (SELECT vec_id//64 AS map_no, vec_id%64 AS r, i-1 AS c,
                           CAST(round(CAST(embedding[i] AS DOUBLE)*1000) AS BIGINT) AS raw
                    FROM embeddings, range(1,65) t(i)))
        JOIN shape USING (map_no)"""),
    "maps": ("shape", "SELECT map_no, height, width FROM shape"),
    "spine": ("shape", "SELECT map_no, i.v AS ci, j.v AS cj FROM shape, range(0,8) i(v), range(0,8) j(v)"),
    "px_cell": ("pixel", "SELECT *, ((r+1)*8-1)//height AS ci, ((c+1)*8-1)//width AS cj FROM pixel"),
    "stroke": ("", """
        SELECT user_id//16 AS map_no, (event_id*37)%64 AS cell, event_id AS seq,
               CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                    ELSE 1+event_id%3 END AS code,
               event_type='signup' AS accepted, 1+CAST(floor(value) AS BIGINT)%3 AS conf,
               CASE event_id%3 WHEN 0 THEN 'draft' WHEN 1 THEN 'saved' ELSE 'bundled' END AS source
        FROM events"""),
    "paint": ("stroke", """
        SELECT map_no, cell//8 AS ci, cell%8 AS cj, code, CASE WHEN code>0 THEN conf ELSE 0 END AS conf,
               code>0 AND accepted AS accepted
        FROM (SELECT map_no, cell, arg_max(code,seq) AS code, arg_max(conf,seq) AS conf, arg_max(accepted,seq) AS accepted
              FROM stroke GROUP BY 1,2)"""),
    "cells": ("stroke", """
        SELECT map_no, source, cell//8 AS ci, cell%8 AS cj, code, CASE WHEN code>0 THEN conf ELSE 0 END AS conf,
               code>0 AND accepted AS accepted
        FROM (SELECT map_no, source, cell, arg_max(code,seq) AS code, arg_max(conf,seq) AS conf, arg_max(accepted,seq) AS accepted
              FROM stroke GROUP BY 1,2,3)"""),
    "labelled": ("px_cell paint", """
        SELECT p.*, CASE WHEN p.z IS NOT NULL AND k.code>0 THEN k.code END AS label
        FROM px_cell p LEFT JOIN paint k USING (map_no, ci, cj)"""),
    "feature": ("pixel", """
        SELECT map_no, r, c, height, width, z,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(z AS DOUBLE)/1000 END AS slope,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(nac AS DOUBLE)/1000 END AS rough,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(abs(raw)%11 AS DOUBLE) END AS svf,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(r%8 AS DOUBLE) END AS rel_local,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(c%8 AS DOUBLE) END AS curv,
               CASE WHEN z IS NULL THEN NULL ELSE CAST(abs(raw)%97 AS DOUBLE) END AS svf_local
        FROM pixel"""),
    "clear": ("px_cell paint", """
        SELECT map_no, r, c, height, width, z, truth, CASE WHEN z IS NOT NULL THEN CAST(truth*100+abs(raw)%7 AS DOUBLE) END AS slope,
               CASE WHEN z IS NOT NULL AND nac IS NOT NULL THEN CAST(truth*50+r%5 AS DOUBLE) END AS rough
        FROM (SELECT p.*, CASE WHEN k.code>0 THEN k.code ELSE 1+(p.map_no+p.ci+2*p.cj)%3 END AS truth FROM px_cell p LEFT JOIN paint k USING (map_no, ci, cj))"""),
    "teach": ("px_cell feature paint", """
        SELECT p.map_no, p.r, p.c, p.z, k.code AS label,
               CASE WHEN k.accepted THEN 0.5::DOUBLE WHEN k.conf=1 THEN 1.0::DOUBLE WHEN k.conf=2 THEN 0.5::DOUBLE
                    WHEN k.conf=3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS w,
               p.ci, p.cj
        FROM px_cell p JOIN paint k USING (map_no, ci, cj) WHERE k.code>0"""),
    "extent": ("", """
        SELECT s_suppkey AS map_no, 5120*(s_suppkey%10) AS l,
               -5120*(s_suppkey//10) - 5*(CASE WHEN s_suppkey//10%10=9 THEN 928 ELSE 1024 END) AS b,
               5120*(s_suppkey%10) + 5*(CASE WHEN s_suppkey%10=9 THEN 128 ELSE 1024 END) AS r,
               -5120*(s_suppkey//10) AS t
        FROM supplier"""),
    "footprint": ("", """
        SELECT c_custkey AS id, c_mktsegment AS crs, l, b, l+w AS r, b+h AS t, held
        FROM (SELECT *, (c_custkey*7919)%20011 AS l, (c_custkey*104729)%20021 AS b,
                     1+(c_custkey*31)%97 + CASE WHEN c_custkey%53=0 THEN 3000 ELSE 0 END AS w,
                     1+(c_custkey*17)%89 AS h, c_custkey%9=4 AS held FROM customer)"""),
    "edge": ("", """
        SELECT 'c'||c_custkey AS alias, CASE WHEN c_custkey%7<>0 THEN 'c'||(c_custkey//2) END AS grp, 1+c_nationkey%3 AS priority FROM customer"""),
    "node": ("", "SELECT 'c'||c_custkey AS node FROM customer"),
    "meta": ("", """
        SELECT user_id//4 AS map_no, event_id%5 AS layer_rank,
               CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'restricted' WHEN 'purchase' THEN 'label_status'
                    WHEN 'signup' THEN 'provenance' ELSE 'note' END AS key,
               arg_max(CASE WHEN event_type IN ('view','click') THEN CASE WHEN event_id%2=0 THEN 'true' ELSE 'false' END
                            ELSE 'v'||event_id END, event_id) AS value
        FROM events GROUP BY 1,2,3"""),
    "merged": ("meta", "SELECT map_no, key, arg_max(value, layer_rank) AS value FROM meta GROUP BY 1,2"),
    "artifact": ("", """
        SELECT user_id*8+event_id%8 AS map_no, CASE WHEN event_id//8%2=0 THEN 'draft' ELSE 'saved' END AS bucket,
               CASE event_id//16%3 WHEN 0 THEN 'current' WHEN 1 THEN 'mirrored' ELSE 'legacy' END AS layout,
               CASE event_type WHEN 'view' THEN 'painting.npy' WHEN 'click' THEN 'labels.tif' WHEN 'purchase' THEN 'meta.json'
                    WHEN 'signup' THEN 'accepted.npy' ELSE 'confidence.npy' END AS file,
               min(CASE WHEN event_id//48%5=0 THEN 100 ELSE 120 END) AS side
        FROM events GROUP BY 1,2,3,4"""),
    "bundle": ("", "SELECT DISTINCT user_id*8+event_id%8 AS map_no, CASE WHEN user_id%6=0 THEN 100 ELSE 120 END AS side FROM events WHERE event_type='signup'"),
    "region_grid": ("", """
        SELECT 'reg'||s_suppkey AS region, 1+(s_suppkey*977)%5000 AS height, 1+(s_suppkey*1013)%4000 AS width,
               CAST(5*(s_suppkey%100) AS DOUBLE) AS x0, CAST(-5*(s_suppkey//100) AS DOUBLE) AS y0
        FROM supplier"""),
    "layout": ("region_grid", """
        SELECT region, 'zenodo-'||region||'-r'||lpad(CAST(tr AS VARCHAR),3,'0')||'-c'||lpad(CAST(tc AS VARCHAR),3,'0') AS tile_id,
               tr AS tile_row, tc AS tile_col, tr*1024 AS row_off, tc*1024 AS col_off,
               least(1024, height-tr*1024) AS tile_height, least(1024, width-tc*1024) AS tile_width,
               x0+5*tc*1024 AS x0, y0-5*tr*1024 AS y0,
               tr*((width+1023)//1024)+tc AS position
        FROM (SELECT *, unnest(range(0,(height+1023)//1024)) AS tr FROM region_grid) q, LATERAL (SELECT unnest(range(0,(q.width+1023)//1024)) AS tc)"""),
    "record": ("", """
        SELECT 'site_'||p_partkey%13 AS manifest_folder,
               CASE p_partkey%11 WHEN 0 THEN '../site_3/tiles/t'||p_partkey||'.tif' WHEN 1 THEN './tiles//t'||p_partkey||'.v2.tif'
                    WHEN 2 THEN '../../outside/t'||p_partkey||'.tif' WHEN 3 THEN '.hidden/t'||p_partkey||'.tif'
                    WHEN 4 THEN '.hidden/../tiles/t'||p_partkey||'.tif' WHEN 5 THEN '../t'||p_partkey||'.tif'
                    ELSE 'tiles/t'||(p_partkey%1900)||'.tif' END AS working_dem,
               CASE WHEN p_size%4=0 THEN p_type WHEN p_size%4=1 THEN '' END AS section,
               'site_'||p_partkey%13 AS site, CASE WHEN p_size%3=0 THEN p_brand END AS grp
        FROM part"""),
    "member": ("", """
        SELECT 'A3CLR22_'||(p_partkey//16)||'_Region_'||(p_partkey//16)||'.zip' AS archive, p_partkey%16 AS position,
               CASE WHEN p_size%2=0 AND p_partkey%16<9 THEN 'A3CLR22_'||(p_partkey//16)||'_Region_'||(p_partkey//16)||'/' ELSE '' END ||
               CASE p_partkey%16
                 WHEN 0 THEN roi||'_GLDOMOS_005.tif' WHEN 1 THEN lower(roi)||'_gldelev_005.TIF' WHEN 2 THEN roi||'_GLDMASK_005.tif'
                 WHEN 3 THEN CASE WHEN p_size>25 THEN roi||'_GLDSBCT_005.tif' ELSE roi||'_GLDSBCTALL_005.tif' END
                 WHEN 4 THEN CASE WHEN p_size%5=0 THEN 'notes.txt' ELSE 'README.txt' END
                 WHEN 5 THEN 'points.csv' WHEN 6 THEN 'More.CSV' WHEN 7 THEN roi||'_GLDSIGM_005.tif'
                 WHEN 8 THEN CASE WHEN p_size%10=0 THEN roi||'_GLDISGM_005.tif' ELSE 'readme.doc' END
                 WHEN 9 THEN 'sub/dir/'||roi||'_GLDELEV_005.tif' WHEN 10 THEN '.hidden.csv' WHEN 11 THEN '__MACOSX/points.csv'
                 WHEN 12 THEN 'A399_GLDELEV_005.tif' ELSE 'misc_'||p_partkey||'.tif' END AS member,
               p_size*40000 AS size
        FROM (SELECT *, 'A3'||CASE WHEN p_partkey//16<10 THEN '0' ELSE '' END||(p_partkey//16) AS roi FROM part)"""),
}


def with_views(sql: str, names: list[str]) -> str:
    """Put the named views, and those they read, in front of a SQL text."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for other in needs.split():
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    text = sql.strip()
    if not order:
        return text
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in order)
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes},\n{text[len('WITH'):]}"
    return f"WITH {ctes}\n{text}"


def text_id(prefix: str, value) -> F.Column:
    return F.concat(F.lit(prefix), value.cast("string"))


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- rasters ---------------------------------------------------------------

    @cached_property
    def shape(self) -> DataFrame:
        """Height and width per map, from the row ids alone."""
        return self.table("embeddings").groupBy(int_div(F.col("vec_id"), SIDE).alias("map_no")).agg(
            (F.max(F.col("vec_id") % SIDE) + 1).alias("height"), F.lit(SIDE).cast("bigint").alias("width")
        )

    @property
    def maps(self) -> DataFrame:
        return self.shape

    @cached_property
    def pixel(self) -> DataFrame:
        return self._pixels(self.table("embeddings"))

    def written(self, *columns: str) -> Views:
        """The same views with the maps, and these columns of the pixels, in written tables: for plans that read them over and over.

        Vectors are dealt by map first, so that files of one part do not unfold in one task.
        """
        out = Views(self.spark, self.sf_dir)
        out.shape = stored(self.shape, "shape")
        out.pixel = stored(out._pixels(self.table("embeddings").repartition(int_div(F.col("vec_id"), SIDE))).select(*columns), "pixel")
        return out

    def _pixels(self, rows: DataFrame) -> DataFrame:
        r, c, raw, z = F.col("r"), F.col("c"), F.col("raw"), F.col("z")
        base = (
            rows
            .select(int_div(F.col("vec_id"), SIDE).alias("map_no"), (F.col("vec_id") % SIDE).alias("r"),
                    F.posexplode("embedding").alias("c", "v"))
            .select("map_no", "r", F.col("c").cast("bigint").alias("c"),
                    F.round(F.col("v").cast("double") * 1000).cast("bigint").alias("raw"))
        )
        hole = ((r * 7 + c * 13) % 29 == 0) | ((F.col("map_no") % 8 == 3) & (r < 20) & (c < 20))
        return (
            base.join(self.shape, "map_no")
            .withColumn("z", F.when(~hole, raw))
            .withColumns({
                "sfs": z,
                "nac": F.when((r * 5 + c * 3) % 17 != 0, raw * 2 + 1000),
                "image_count": F.when((r * 3 + c) % 23 != 0, F.abs(raw + r + c) % 4),
                "pred": F.when(z.isNotNull(), 1 + F.abs(raw + 7 * int_div(r, 8) + 3 * int_div(c, 8)) % 3),
            })
        )

    @cached_property
    def labelled(self) -> DataFrame:
        from cellscape.operators.grid import cells_to_labels

        return cells_to_labels(self.pixel, self.paint, GRID)

    @cached_property
    def feature(self) -> DataFrame:
        """Pixels with six numeric features, NULL on holes; `rough` has holes of its own."""
        z, raw = F.col("z"), F.col("raw")
        made = {
            "slope": z.cast("double") / 1000, "rough": F.col("nac").cast("double") / 1000,
            "svf": (F.abs(raw) % 11).cast("double"), "rel_local": (F.col("r") % 8).cast("double"),
            "curv": (F.col("c") % 8).cast("double"), "svf_local": (F.abs(raw) % 97).cast("double"),
        }
        return self.pixel.select("map_no", "r", "c", "height", "width", "z",
                                 *[F.when(z.isNotNull(), v).alias(k) for k, v in made.items()])

    @cached_property
    def clear(self) -> DataFrame:
        """Pixels whose features tell their unit (`truth`) beyond doubt: any learner must get it right.

        The unit is the painted one, or a rule of the cell where nothing is painted.
        """
        from cellscape.operators.grid import with_cells

        painted = self.paint.where("code > 0").select("map_no", "ci", "cj", "code")
        rows = with_cells(self.pixel, GRID).join(painted, ["map_no", "ci", "cj"], "left")
        t, z = F.coalesce("code", 1 + (F.col("map_no") + F.col("ci") + 2 * F.col("cj")) % 3), F.col("z")
        made = {
            "slope": t * 100 + F.abs(F.col("raw")) % 7, "rough": F.when(F.col("nac").isNotNull(), t * 50 + F.col("r") % 5), "svf": t * 10 + F.col("c") % 3,
            "rel_local": -20 * t + F.col("r") % 9, "curv": t / 4, "svf_local": t * 1000 + F.col("c"),
        }
        return rows.select("map_no", "r", "c", "height", "width", "z", t.cast("int").alias("truth"),
                           *[F.when(z.isNotNull(), x.cast("double")).alias(k) for k, x in made.items()])

    # -- strokes and paintings ---------------------------------------------------

    @cached_property
    def stroke(self) -> DataFrame:
        e, kind = F.col("event_id"), F.col("event_type")
        code = (
            F.when(kind == "error", 0).when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3)
            .otherwise(1 + e % 3)
        )
        return self.table("events").select(
            int_div(F.col("user_id"), 16).alias("map_no"), (e * 37 % 64).alias("cell"), e.alias("seq"),
            code.alias("code"), (kind == "signup").alias("accepted"),
            (1 + F.floor("value").cast("bigint") % 3).alias("conf"),
            F.when(e % 3 == 0, "draft").when(e % 3 == 1, "saved").otherwise("bundled").alias("source"),
        )

    @staticmethod
    def _as_cells(folded: DataFrame, *extra: str) -> DataFrame:
        return folded.select("map_no", *extra, int_div(F.col("cell"), GRID).alias("ci"), (F.col("cell") % GRID).alias("cj"),
                             "code", "conf", "accepted")

    @cached_property
    def paint(self) -> DataFrame:
        """One painting per map: the whole stroke log folded."""
        return self._as_cells(folded_strokes(self.stroke))

    @cached_property
    def cells(self) -> DataFrame:
        """One painting per map and source."""
        keyed = self.stroke.withColumn("map_no", F.struct("map_no", "source"))
        return self._as_cells(
            folded_strokes(keyed).select(F.col("map_no.map_no").alias("map_no"), F.col("map_no.source").alias("source"),
                                         "cell", "code", "conf", "accepted"), "source")

    @cached_property
    def teach(self) -> DataFrame:
        from cellscape.operators.training import training_pixels

        return training_pixels(self.feature, self.paint, GRID)

    # -- geometry, graphs, catalogs ----------------------------------------------

    @cached_property
    def extent(self) -> DataFrame:
        k, row = F.col("s_suppkey"), int_div(F.col("s_suppkey"), 10)
        return self.table("supplier").select(
            k.alias("map_no"), (5120 * (k % 10)).alias("l"),
            (-5120 * row - 5 * F.when(row % 10 == 9, 928).otherwise(1024)).alias("b"),
            (5120 * (k % 10) + 5 * F.when(k % 10 == 9, 128).otherwise(1024)).alias("r"), (-5120 * row).alias("t"),
        )

    @cached_property
    def footprint(self) -> DataFrame:
        k = F.col("c_custkey")
        left, low = k * 7919 % 20011, k * 104729 % 20021
        return self.table("customer").select(
            k.alias("id"), F.col("c_mktsegment").alias("crs"), left.alias("l"), low.alias("b"),
            (left + 1 + k * 31 % 97 + F.when(k % 53 == 0, 3000).otherwise(0)).alias("r"),
            (low + 1 + k * 17 % 89).alias("t"), (k % 9 == 4).alias("held"),
        )

    @cached_property
    def edge(self) -> DataFrame:
        """A seventh of the aliases belong to no group."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            text_id("c", k).alias("alias"), F.when(k % 7 != 0, text_id("c", int_div(k, 2))).alias("grp"), (1 + F.col("c_nationkey") % 3).alias("priority")
        )

    @cached_property
    def meta(self) -> DataFrame:
        kind, e = F.col("event_type"), F.col("event_id")
        key = (
            F.when(kind == "view", "verified").when(kind == "click", "restricted").when(kind == "purchase", "label_status")
            .when(kind == "signup", "provenance").otherwise("note")
        )
        value = F.when(kind.isin("view", "click"), F.when(e % 2 == 0, "true").otherwise("false")).otherwise(text_id("v", e))
        return self.table("events").groupBy(
            int_div(F.col("user_id"), 4).alias("map_no"), (e % 5).alias("layer_rank"), key.alias("key")
        ).agg(F.max_by(value, e).alias("value"))

    @cached_property
    def artifact(self) -> DataFrame:
        kind, e = F.col("event_type"), F.col("event_id")
        layout = int_div(e, 16) % 3
        file = (
            F.when(kind == "view", "painting.npy").when(kind == "click", "labels.tif").when(kind == "purchase", "meta.json")
            .when(kind == "signup", "accepted.npy").otherwise("confidence.npy")
        )
        return self.table("events").groupBy(
            (F.col("user_id") * 8 + e % 8).alias("map_no"),
            F.when(int_div(e, 8) % 2 == 0, "draft").otherwise("saved").alias("bucket"),
            F.when(layout == 0, "current").when(layout == 1, "mirrored").otherwise("legacy").alias("layout"),
            file.alias("file"),
        ).agg(F.min(F.when(int_div(e, 48) % 5 == 0, 100).otherwise(120)).alias("side"))

    @cached_property
    def bundle(self) -> DataFrame:
        return self.table("events").where("event_type = 'signup'").select(
            (F.col("user_id") * 8 + F.col("event_id") % 8).alias("map_no"),
            F.when(F.col("user_id") % 6 == 0, 100).otherwise(120).alias("side"),
        ).distinct()

    @cached_property
    def region_grid(self) -> DataFrame:
        k = F.col("s_suppkey")
        zero, five = F.lit(0.0), F.lit(5.0)
        return self.table("supplier").select(
            text_id("reg", k).alias("region"), (1 + k * 977 % 5000).alias("height"), (1 + k * 1013 % 4000).alias("width"),
            F.array(five, zero, (5 * (k % 100)).cast("double"), zero, -five, (-5 * int_div(k, 100)).cast("double")).alias("transform"),
        )

    @cached_property
    def record(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")

        def file(folder: str, number, ext: str = ".tif"):
            return F.concat(F.lit(folder + "t"), number.cast("string"), F.lit(ext))

        dem = (
            F.when(k % 11 == 0, file("../site_3/tiles/", k)).when(k % 11 == 1, file("./tiles//", k, ".v2.tif"))
            .when(k % 11 == 2, file("../../outside/", k)).when(k % 11 == 3, file(".hidden/", k))
            .when(k % 11 == 4, file(".hidden/../tiles/", k)).when(k % 11 == 5, file("../", k))
            .otherwise(file("tiles/", k % 1900))
        )
        return self.table("part").select(
            text_id("site_", k % 13).alias("manifest_folder"), dem.alias("working_dem"),
            F.when(size % 4 == 0, F.col("p_type")).when(size % 4 == 1, F.lit("")).alias("section"),
            text_id("site_", k % 13).alias("site"), F.when(size % 3 == 0, F.col("p_brand")).alias("grp"), k.alias("part_no"),
        )

    @cached_property
    def member(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        no, i = int_div(k, 16), k % 16
        roi = F.concat(F.lit("A3"), F.when(no < 10, "0").otherwise(""), no.cast("string"))
        folder = F.concat(F.lit("A3CLR22_"), no.cast("string"), F.lit("_Region_"), no.cast("string"))

        def product(code: str):
            return F.concat(roi, F.lit(f"_{code}_005.tif"))

        name = (
            F.when(i == 0, product("GLDOMOS")).when(i == 1, F.concat(F.lower(roi), F.lit("_gldelev_005.TIF")))
            .when(i == 2, product("GLDMASK"))
            .when(i == 3, F.when(size > 25, product("GLDSBCT")).otherwise(product("GLDSBCTALL")))
            .when(i == 4, F.when(size % 5 == 0, "notes.txt").otherwise("README.txt"))
            .when(i == 5, "points.csv").when(i == 6, "More.CSV").when(i == 7, product("GLDSIGM"))
            .when(i == 8, F.when(size % 10 == 0, product("GLDISGM")).otherwise("readme.doc"))
            .when(i == 9, F.concat(F.lit("sub/dir/"), product("GLDELEV"))).when(i == 10, ".hidden.csv")
            .when(i == 11, "__MACOSX/points.csv").when(i == 12, "A399_GLDELEV_005.tif")
            .otherwise(F.concat(F.lit("misc_"), k.cast("string"), F.lit(".tif")))
        )
        nested = F.when((size % 2 == 0) & (i < 9), F.concat(folder, F.lit("/"))).otherwise("")
        return self.table("part").select(
            F.concat(folder, F.lit(".zip")).alias("archive"), i.alias("position"),
            F.concat(nested, name).alias("member"), (size * 40000).alias("size"),
        )
