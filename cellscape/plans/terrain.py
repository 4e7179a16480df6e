"""Queries over neighbourhoods.  Results are compared in whole thousandths."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellscape.functions.constants import CURV_M, LOCAL_M, REL_M, ROUGH_M, SKY_LOCAL_M, SKY_M
from cellscape.operators import build, graph, regrid, stencil
from cellscape.plans.registry import query
from cellscape.plans.views import PX, Views

KEY = ["map_no", "r", "c"]


def milli(*names: str):
    return [F.round(F.col(n) * 1000).cast("bigint").alias(n) for n in names]


# -- the same stencils in SQL: one weight per (target, source) position of an axis ------


def axis_weights(name: str, sigma: float, second: bool = False) -> str:
    """Folded reflect-edge Gaussian weights for every side length in use."""
    reach = int(4 * sigma + 0.5)
    factor = f"*(d*d/power({sigma!r}::DOUBLE,4)-1/power({sigma!r}::DOUBLE,2))" if second else ""
    return f"""{name} AS (SELECT n, t, s, sum(w) AS w FROM (
        SELECT n, t, CASE WHEN m<n THEN m ELSE 2*n-1-m END AS s, w FROM (
          SELECT n, t, ((t+d)%(2*n)+2*n)%(2*n) AS m, w FROM (SELECT DISTINCT height AS n FROM shape UNION SELECT width FROM shape), range(0,64) x(t),
            (SELECT d, e/sum(e) OVER (){factor} AS w FROM (SELECT d, exp(-0.5*d*d/power({sigma!r}::DOUBLE,2)) AS e FROM range({-reach},{reach + 1}) k(d))) WHERE t<n)) GROUP BY 1,2,3)"""


def smoothed(name: str, source: str, value: str, rows: str, cols: str) -> str:
    """Two one-axis passes of weight tables over `source`."""
    return f"""{name}_1 AS (SELECT map_no, k.t AS r, x.c, x.height, x.width, sum(k.w*x.{value}) AS v FROM {source} x JOIN {rows} k ON k.n=x.height AND k.s=x.r GROUP BY 1,2,3,4,5),
    {name} AS (SELECT map_no, r, k.t AS c, sum(k.w*v) AS v FROM {name}_1 JOIN {cols} k ON k.n=width AND k.s=c GROUP BY 1,2,3)"""


def gradient(name: str, source: str, value: str) -> str:
    def axis(order: str, along: str) -> str:
        w = f"OVER (PARTITION BY map_no, {along} ORDER BY {order})"
        up, down = f"lead({value}) {w}", f"lag({value}) {w}"
        return f"CASE WHEN {down} IS NULL THEN ({up}-{value})/{PX} WHEN {up} IS NULL THEN ({value}-{down})/{PX} ELSE ({up}-{down})/{2 * PX} END"

    return f"{name} AS (SELECT map_no, r, c, height, width, {axis('c', 'r')} AS gx, {axis('r', 'c')} AS gy FROM {source})"


def sky(name: str, source: str, value: str, px: float, max_m: float, n_ray: int) -> str:
    reach = max(max_m / px, 2)
    return f"""{name}_d AS (SELECT DISTINCT CAST(round_even(power(10.0::DOUBLE, i*log10({reach!r}::DOUBLE)/{n_ray - 1}),0) AS BIGINT) AS d FROM range(0,{n_ray}) q(i)),
    {name}_o AS (SELECT k, d, CAST(round_even(d*cos(2*pi()*k/16),0) AS BIGINT) AS dr, CAST(round_even(d*sin(2*pi()*k/16),0) AS BIGINT) AS dc FROM {name}_d, range(0,16) q(k) WHERE d>=1),
    {name}_p AS MATERIALIZED (SELECT (map_no*4096+r)*4096+c AS pid, CAST({value} AS DOUBLE) AS v FROM {source}),
    {name}_h AS (SELECT gid, max(rise) AS h FROM (SELECT a.pid*16+a.k AS gid, (b.v-a.v)/(a.d*{px!r}::DOUBLE) AS rise
      FROM (SELECT pid, v, k, d, pid+dr*4096+dc AS other FROM {name}_p, {name}_o WHERE dr<>0 OR dc<>0) a JOIN {name}_p b ON b.pid=a.other) GROUP BY 1),
    {name}_m AS (SELECT gid//16 AS pid, count(*) AS n, sum(1-sin(atan(greatest(0,h)))) AS s FROM {name}_h GROUP BY 1),
    {name} AS (SELECT p.pid//16777216 AS map_no, p.pid//4096%4096 AS r, p.pid%4096 AS c, (16-coalesce(n,0)+coalesce(s,0))/16 AS v FROM {name}_p p LEFT JOIN {name}_m m ON m.pid=p.pid)"""


def near_sky(name: str, source: str, value: str, px: float, max_m: float, n_ray: int) -> str:
    """`sky` on full rasters of 64 columns: a neighbour is so many places further in row order, so no join is needed."""
    rays = stencil.sky_offsets(px, max_m, n_ray)

    def rise(d: int, dr: int, dc: int) -> str:
        inside = f"r+{dr}>=0 AND r+{dr}<height AND c+{dc}>=0 AND c+{dc}<64".replace("+-", "-")
        return f"CASE WHEN {inside} THEN (lead(v, {dr * 64 + dc}) OVER w-v)/({d}*{px!r}::DOUBLE) END"

    turns = [f"greatest(0, {', '.join(rise(*step) for step in ray)}) AS h{k}" for k, ray in enumerate(rays)]
    total = "+".join(f"1-sin(atan(h{k}))" for k in range(len(rays)))
    return f"""{name} AS (SELECT map_no, r, c, ({total})/{len(rays)} AS v FROM (SELECT map_no, r, c, {", ".join(turns)}
      FROM (SELECT map_no, r, c, height, CAST({value} AS DOUBLE) AS v FROM {source}) WINDOW w AS (PARTITION BY map_no ORDER BY r*64+c)))"""


def zoomed(name: str, source: str, value: str, h: str, w: str, extra: str = "") -> str:
    """End-aligned bilinear zoom of `source` to h x w."""
    def weights(side: str, size: str, target: str) -> str:
        return f"""{name}_{side} AS (SELECT n, m, t, s, 1-abs(u-s) AS w FROM (SELECT n, m, t, CASE WHEN m>1 THEN t*(n-1)/(m-1)::DOUBLE ELSE 0 END AS u FROM
            (SELECT DISTINCT {size} AS n, {target} AS m FROM {source}), range(0,200) q(t) WHERE t<m), range(0,200) p(s) WHERE s<n AND abs(u-s)<1)"""
    return f"""{weights('r', 'height', h)}, {weights('c', 'width', w)},
    {name}_v AS (SELECT map_no, a.t AS r, b.t AS c, sum(a.w*b.w*{value}) AS v FROM {source}
      JOIN {name}_r a ON a.n=height AND a.m={h} AND a.s=r JOIN {name}_c b ON b.n=width AND b.m={w} AND b.s=c GROUP BY 1,2,3),
    {name} AS (SELECT q.map_no, q.r, q.c, q.v, o.* EXCLUDE (map_no) FROM {name}_v q JOIN (SELECT map_no, max({h}) AS height, max({w}) AS width{extra} FROM {source} GROUP BY 1) o ON o.map_no=q.map_no)"""


def wide_sky(name: str, source: str, value: str) -> str:
    small = "CAST(greatest(1,round_even({0}/4::DOUBLE,0)) AS BIGINT)"
    return ",\n".join([
        zoomed(f"{name}_z", source, value, small.format("height"), small.format("width"), ", max(height) AS h0, max(width) AS w0"),
        sky(f"{name}_s", f"{name}_z", "v", PX * 4, SKY_M, 48),
        f"{name}_j AS (SELECT s.map_no, s.r, s.c, z.height, z.width, h0, w0, s.v AS sv FROM {name}_s s JOIN {name}_z z USING (map_no, r, c))",
        zoomed(name, f"{name}_j", "sv", "h0", "w0"),
    ])


def sigma(metres: float) -> float:
    return metres / math.sqrt(12) / PX


# Nearest valid pixel of the column first, then the nearest of those in the row: one join on one key.
FILL = """fill_c AS MATERIALIZED (SELECT map_no*4096+r AS line, map_no, r, c, height, width, z, CASE WHEN below IS NULL OR r-above<=below-r THEN above ELSE below END AS nr,
      CASE WHEN below IS NULL OR r-above<=below-r THEN za ELSE zb END AS nz FROM (SELECT map_no, r, c, height, width, z,
        last_value(CASE WHEN z IS NOT NULL THEN r END IGNORE NULLS) OVER up AS above, last_value(z IGNORE NULLS) OVER up AS za,
        first_value(CASE WHEN z IS NOT NULL THEN r END IGNORE NULLS) OVER down AS below, first_value(z IGNORE NULLS) OVER down AS zb FROM pixel
        WINDOW up AS (PARTITION BY map_no, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               down AS (PARTITION BY map_no, c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
    fill_s AS MATERIALIZED (SELECT line, list({'r': nr, 'c': c, 'z': nz}) AS sites FROM fill_c WHERE nr IS NOT NULL GROUP BY line),
    fill_b AS (SELECT map_no, r, c, height, width, min({'d': (s.r-r)*(s.r-r)+(s.c-c)*(s.c-c), 'r': s.r, 'c': s.c, 'z': s.z}) AS b
      FROM (SELECT h.map_no, h.r, h.c, h.height, h.width, unnest(f.sites) AS s FROM fill_c h JOIN fill_s f ON f.line=h.line WHERE h.z IS NULL) GROUP BY 1,2,3,4,5),
    fill AS (SELECT map_no, r, c, height, width, true AS hole, b.r AS fr, b.c AS fc, CAST(b.z AS DOUBLE) AS filled FROM fill_b
    UNION ALL SELECT map_no, r, c, height, width, false, r, c, CAST(z AS DOUBLE) FROM pixel WHERE z IS NOT NULL)"""

SLOPE = "{0} AS (SELECT map_no, r, c, height, width, degrees(atan(sqrt(gx*gx+gy*gy))) AS s, power(degrees(atan(sqrt(gx*gx+gy*gy))),2) AS s2 FROM {1})"

FEATURES = ",\n".join([
    FILL, gradient("grad", "fill", "filled"), SLOPE.format("slope", "grad"),
    axis_weights("k_rough", sigma(ROUGH_M)), axis_weights("k_local", sigma(LOCAL_M)),
    axis_weights("k_curv", sigma(CURV_M)), axis_weights("k_curv2", sigma(CURV_M), True),
    smoothed("m1", "slope", "s", "k_rough", "k_rough"), smoothed("m2", "slope", "s2", "k_rough", "k_rough"),
    smoothed("loc", "fill", "filled", "k_local", "k_local"),
    smoothed("cr", "fill", "filled", "k_curv2", "k_curv"), smoothed("cc", "fill", "filled", "k_curv", "k_curv2"),
    sky("near", "fill", "filled", PX, SKY_LOCAL_M, 16), wide_sky("wide", "fill", "filled"),
    f"""feat AS (SELECT f.map_no, f.r, f.c, hole, slope.s AS slope, sqrt(greatest(m2.v-m1.v*m1.v,0)) AS rough, wide.v AS svf, filled-loc.v AS rel_local,
      (cr.v+cc.v)/{PX * PX} AS curv, near.v AS svf_local FROM fill f JOIN slope USING (map_no,r,c) JOIN m1 USING (map_no,r,c) JOIN m2 USING (map_no,r,c) JOIN loc USING (map_no,r,c)
      JOIN cr USING (map_no,r,c) JOIN cc USING (map_no,r,c) JOIN near USING (map_no,r,c) JOIN wide ON wide.map_no=f.map_no AND wide.r=f.r AND wide.c=f.c)""",
])
SIX = ["slope", "rough", "svf", "rel_local", "curv", "svf_local"]
SIX_SQL = ", ".join(f"CASE WHEN NOT hole THEN CAST(round({n}*1000) AS BIGINT) END AS {n}" for n in SIX)


@query("N1_slope", f"WITH {gradient('grad', 'pixel', 'raw')}, {SLOPE.format('slope', 'grad')} SELECT map_no, r, c, CAST(round(s*1000) AS BIGINT) AS slope FROM slope", "pixel")
def slope(v: Views):
    return stencil.slope(v.pixel, "raw", PX).select(*KEY, *milli("slope"))


@query("N2_gaussian", f"WITH {axis_weights('k', 3.0)}, {smoothed('g', 'pixel', 'raw', 'k', 'k')} SELECT map_no, r, c, CAST(round(v*1000) AS BIGINT) AS smooth FROM g", "pixel shape")
def gaussian(v: Views):
    return stencil.gaussian(v.pixel, "raw", 3.0, block=32).select(*KEY, *milli("smooth"))


@query("N3_local_deviation", f"WITH sq AS (SELECT *, raw*raw AS raw2 FROM pixel), {axis_weights('k', 2.0)}, {smoothed('a', 'sq', 'raw', 'k', 'k')}, {smoothed('b', 'sq', 'raw2', 'k', 'k')} "
       "SELECT map_no, r, c, CAST(round(1000*sqrt(greatest(b.v-a.v*a.v,0))) AS BIGINT) AS deviation FROM a JOIN b USING (map_no, r, c)", "pixel shape")
def local_deviation(v: Views):
    return stencil.local_deviation(v.pixel, "raw", 2.0, block=40).select(*KEY, *milli("deviation"))


def _height_sql(metres: float) -> str:
    return (f"WITH {axis_weights('k', sigma(metres))}, {smoothed('g', 'pixel', 'raw', 'k', 'k')} "
            "SELECT map_no, r, c, CAST(round((raw-g.v)*1000) AS BIGINT) AS local_height FROM pixel JOIN g USING (map_no, r, c)")


@query("N4_local_height", _height_sql(LOCAL_M), "pixel shape")
def local_height(v: Views):
    return stencil.local_height(v.pixel, "raw", LOCAL_M, PX).select(*KEY, *milli("local_height"))


@query("N4_scene_height", _height_sql(REL_M), "pixel shape")
def scene_height(v: Views):
    """A 924-pixel window: the two-pass form."""
    return stencil.scene_height(v.pixel, "raw", PX).select(*KEY, *milli("local_height"))


@query("N5_curvature", f"WITH {axis_weights('k', sigma(CURV_M))}, {axis_weights('k2', sigma(CURV_M), True)}, {smoothed('a', 'pixel', 'raw', 'k2', 'k')}, {smoothed('b', 'pixel', 'raw', 'k', 'k2')} "
       f"SELECT map_no, r, c, CAST(round((a.v+b.v)/{PX * PX}*1000) AS BIGINT) AS curv FROM a JOIN b USING (map_no, r, c)", "pixel shape")
def curvature(v: Views):
    return stencil.curvature(v.pixel, "raw", PX).select(*KEY, *milli("curv"))


@query("N6_sky_view_local", f"WITH {near_sky('s', 'pixel', 'raw', PX, SKY_LOCAL_M, 16)} SELECT map_no, r, c, CAST(round(v*1000) AS BIGINT) AS svf FROM s", "pixel")
def sky_view_local(v: Views):
    return stencil.sky_view(v.pixel, "raw", PX, SKY_LOCAL_M, 16, 1).select(*KEY, *milli("svf"))


@query("N6_sky_view_wide", f"WITH {wide_sky('s', 'pixel', 'raw')} SELECT map_no, r, c, CAST(round(v*1000) AS BIGINT) AS svf FROM s", "pixel")
def sky_view_wide(v: Views):
    return stencil.sky_view(v.pixel, "raw", PX).select(*KEY, *milli("svf"))


@query("N7_zoom", f"WITH {zoomed('q', 'pixel', 'raw', 'height*2-5', 'width//3')} SELECT map_no, r, c, CAST(round(v*1000) AS BIGINT) AS raw FROM q", "pixel")
def zoom(v: Views):
    px = v.pixel.withColumns({"t_height": F.col("height") * 2 - 5, "t_width": F.floor(F.col("width") / 3)})
    return regrid.zoom(px, ["map_no"], "raw").select(*KEY, *milli("raw"))


@query("N8_nearest_fill", f"WITH {FILL} SELECT map_no, r, c, hole, fr, fc, CAST(filled AS BIGINT) AS filled FROM fill", "pixel")
def nearest_fill(v: Views):
    return stencil.nearest_fill(v.pixel, "z").select(*KEY, "hole", "fr", "fc", F.col("filled").cast("bigint").alias("filled"))


@query("N9_hillshade", f"WITH {axis_weights('k', 2.0)}, {smoothed('g0', 'pixel', 'raw', 'k', 'k')}, g AS (SELECT g0.*, height, width FROM g0 JOIN shape USING (map_no)), {gradient('grad', 'g', 'v')} "
       """SELECT map_no, r, c, CAST(round(1000*greatest(0,least(1, sin(radians(25))*cos(sl)+cos(radians(25))*sin(sl)*cos(radians(315)-asp)))) AS BIGINT) AS shade
       FROM (SELECT map_no, r, c, atan(sqrt(gx*gx+gy*gy)) AS sl, atan2(-gy,gx) AS asp FROM grad)""", "pixel shape")
def hillshade(v: Views):
    return stencil.hillshade(v.pixel, "raw", PX).select(*KEY, *milli("shade"))


@query("N11_terrain_features", f"WITH {FEATURES} SELECT map_no, r, c, {SIX_SQL} FROM feat", "pixel shape")
def terrain_features(v: Views):
    return stencil.terrain_features(v.pixel, "z", PX).select(*KEY, *milli(*SIX))


@query("N12_context_features", f"WITH {FEATURES} SELECT map_no*2+c//32 AS map_no, r, c%32 AS c, {SIX_SQL} FROM feat", "pixel shape")
def context_features(v: Views):
    """Every map cut into two tiles; joined again, the seam must not show."""
    half = F.floor(F.col("c") / 32)
    px = v.pixel.select((F.col("map_no") * 2 + half).alias("map_no"), "r", (F.col("c") % 32).alias("c"), "z",
                        "height", F.lit(32).cast("bigint").alias("width"))
    five, zero = F.lit(PX), F.lit(0.0)
    side = v.shape.select("map_no", "height", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select(
        (F.col("map_no") * 2 + F.col("half")).alias("map_no"), "height", F.lit(32).cast("bigint").alias("width"), F.lit("moon").alias("crs"),
        F.array(five, zero, (F.col("map_no") * 1000 + F.col("half") * 32) * five, zero, -five, zero).alias("transform"))
    return stencil.context_features(px, graph.tile_contexts(side), "z", PX).select(*KEY, *milli(*SIX))


# -- features over a graph of sources ------------------------------------------------
#
# Of every raster m: its halves 3m, 3m+1 (leaves, adjoining), a mosaic 3m+2 of both, a coarse map
# 100000+m over the mosaic, a map 200000+m that takes its left half from two sources, and two
# maps 300000+m, 400000+m that wait for each other.


def source_graph(v: Views):
    """(px, grids, sources, requested)

    Every level reads the pixels of all six kinds of map, and every step over the graph the maps.
    """
    v = v.written("map_no", "r", "c", "height", "width", "raw", "z")
    m, half, five, ten, zero = F.col("map_no"), F.floor(F.col("c") / 32), F.lit(PX), F.lit(2 * PX), F.lit(0.0)
    px = v.pixel.select("map_no", "r", "c", "height", "width", "raw", "z")
    whole = px.withColumn("z", F.when((F.col("r") + F.col("c")) % 11 != 0, F.col("raw")))
    leaf = px.select((m * 3 + half).alias("map_no"), "r", (F.col("c") % 32).alias("c"), "height", F.lit(32).cast("bigint").alias("width"), "z")
    coarse = px.select(
        (m + 100000).alias("map_no"), F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c"), F.floor(F.col("height") / 2).alias("height"),
        F.lit(32).cast("bigint").alias("width"), F.when(F.col("raw") % 7 != 0, F.col("raw")).alias("z"), (F.col("r") % 2 + F.col("c") % 2).alias("odd"))
    coarse = coarse.where("odd = 0 and r < height").drop("odd")
    same = lambda no: whole.select(no.alias("map_no"), "r", "c", "height", "width", "z")
    pixels = leaf.unionByName(coarse)
    for no in (m * 3 + 2, m + 200000, m + 300000, m + 400000):
        pixels = pixels.unionByName(same(no))

    def grid(no, height, width: int, px, left=0):
        return v.shape.select(no.alias("map_no"), F.lit("moon").alias("crs"), height.alias("height"), F.lit(width).cast("bigint").alias("width"),
                              F.array(px, zero, (m * 1000 + left) * five, zero, -px, zero).alias("transform"))

    h = F.col("height")
    grids = grid(m * 3, h, 32, five).unionByName(grid(m * 3 + 1, h, 32, five, 32)).unionByName(grid(m + 100000, F.floor(h / 2), 32, ten))
    for no in (m * 3 + 2, m + 200000, m + 300000, m + 400000):
        grids = grids.unionByName(grid(no, h, 64, five))
    link = F.explode(F.array(*[F.struct(a.alias("map_no"), b.alias("source")) for a, b in (
        (m * 3 + 2, m * 3), (m * 3 + 2, m * 3 + 1), (m + 100000, m * 3 + 2), (m + 200000, m * 3), (m + 200000, m * 3 + 2),
        (m + 300000, m + 400000), (m + 400000, m + 300000), (m + 300000, m + 500000))]))
    sources = v.shape.select(link.alias("l")).select("l.*")
    requested = v.shape.select(F.explode(F.array(m + 100000, m + 200000, m + 300000)).alias("map_no"))
    return pixels, grids, sources, requested


_ONE = ", ".join(f"CASE WHEN f.{n} IS NOT NULL AND (f.r+f.c)%11<>0 THEN f.{n} END AS {n}" for n in SIX)
_MILLI = ", ".join(f"CASE WHEN {{0}} THEN CAST(round(o.{n}*1000) AS BIGINT) END AS {n}" for n in SIX)


@query("build_source_graph", f"""WITH {FEATURES}, f AS (SELECT map_no, r, c, height, {", ".join(f"CASE WHEN NOT hole THEN {n} END AS {n}" for n in SIX)} FROM feat JOIN shape USING (map_no)),
    one AS MATERIALIZED (SELECT f.map_no, f.r, f.c, f.height, {_ONE} FROM f)
    SELECT o.map_no+100000 AS map_no, o.r//2 AS r, o.c//2 AS c, {_MILLI.format('p.raw%7<>0')} FROM one o JOIN pixel p ON p.map_no=o.map_no AND p.r=o.r-1 AND p.c=o.c-1 WHERE o.r%2=1 AND o.c%2=1
    UNION ALL SELECT o.map_no+200000, o.r, o.c, {_MILLI.format('o.c>=32')} FROM one o""", "pixel shape")
def build_features(v: Views):
    """Six features of the coarse maps and of those with two sources on their left half."""
    px, grids, sources, requested = source_graph(v)
    return build.build(px, grids, sources, requested, "z", PX).select(*KEY, *milli(*SIX))


@query("build_issues", """
    SELECT map_no+200000 AS map_no, map_no*3 AS source, 'overlaps source '||(map_no*3+2)||' on '||(height*32)||' pixels' AS issue FROM shape
    UNION ALL SELECT map_no+300000, map_no+500000, 'unknown map' FROM shape
    UNION ALL SELECT map_no+k, NULL, 'waits for a cycle' FROM shape, (VALUES (300000), (400000)) t(k)""", "shape")
def build_issues(v: Views):
    return build.source_issues(*source_graph(v))


@query("build_local_channels", f"""WITH {FILL}, {axis_weights('k_rel', sigma(REL_M))}, {smoothed('far', 'fill', 'filled', 'k_rel', 'k_rel')},
    {axis_weights('k', 2.0)}, {smoothed('g0', 'fill', 'filled', 'k', 'k')}, g AS (SELECT g0.*, height, width FROM g0 JOIN shape USING (map_no)), {gradient('grad', 'g', 'v')},
    sh AS (SELECT map_no, r, c, greatest(0,least(1, sin(radians(25))*cos(sl)+cos(radians(25))*sin(sl)*cos(radians(315)-asp))) AS shade
           FROM (SELECT map_no, r, c, atan(sqrt(gx*gx+gy*gy)) AS sl, atan2(-gy,gx) AS asp FROM grad)),
    med AS (SELECT map_no, median(filled) AS m FROM fill GROUP BY 1)
    SELECT map_no, r, c, CASE WHEN NOT hole THEN CAST(round((filled-far.v)*1000) AS BIGINT) END AS rel, CASE WHEN NOT hole THEN CAST(round((filled-m)*1000) AS BIGINT) END AS zscene,
      CASE WHEN hole THEN 0 ELSE CAST(round(shade*1000) AS BIGINT) END AS shade FROM fill JOIN far USING (map_no, r, c) JOIN sh USING (map_no, r, c) JOIN med USING (map_no)""", "pixel shape")
def build_local(v: Views):
    return build.local_channels(v.pixel, "z", PX).select(*KEY, *milli("rel", "zscene", "shade"))


def _resize_sql(h: str, w: str) -> str:
    def axis(name: str, size: str, target: str) -> str:
        return f"""{name} AS (SELECT n, m, t, s, w, s=((2*t+1)*n)//(2*m) AS near FROM (SELECT *, 1-abs(s-ctr+0.5)/sup AS w FROM (
            SELECT n, m, t, s, (t+0.5::DOUBLE)*n/m AS ctr, greatest(1,n/m::DOUBLE) AS sup FROM (SELECT DISTINCT {size} AS n, {target} AS m FROM shape), range(0,200) q(t), range(0,64) p(s) WHERE t<m AND s<n)
            WHERE s>=greatest(0,floor(ctr-sup+0.5)) AND s<floor(ctr+sup+0.5)) WHERE w>0)"""
    return f"""WITH {axis('a', 'height', h)}, {axis('b', 'width', w)}
    SELECT map_no, r, c, CASE WHEN NOT gone THEN CAST(round(1000*v) AS BIGINT) END AS z FROM (SELECT map_no, a.t AS r, b.t AS c, sum(a.w*b.w*coalesce(z,0))/sum(a.w*b.w) AS v, bool_or(a.near AND b.near AND z IS NULL) AS gone
      FROM pixel JOIN a ON a.n=height AND a.s=r JOIN b ON b.n=width AND b.s=c GROUP BY 1,2,3)"""


@query("N14_resize", _resize_sql("height//3", "width*2-7"), "pixel shape")
def resize(v: Views):
    px = v.pixel.withColumns({"t_height": F.floor(F.col("height") / 3), "t_width": F.col("width") * 2 - 7})
    return regrid.resized(px, ["map_no"], "z").select(*KEY, *milli("z"))
