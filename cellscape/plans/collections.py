"""Queries over catalogs, archives, graphs and tile groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions import raster as R
from cellscape.operators import catalog, graph, grid, labels, manifest, tiles
from cellscape.plans.pixels import LAYOUT_PROBLEMS, RECORDED, positioned_layout, recorded_layout
from cellscape.plans.registry import query
from cellscape.plans.views import GRID, Views, text_id
from cellscape.session import scratch_path
from cellscape.sources import sinks

ROOT = "/data/dems"

# Resolving by repeated replacement: another way to the same answer for shallow paths.
def _resolved(path: str) -> str:
    out = f"regexp_replace(regexp_replace({path},'/\\./','/','g'),'//+','/','g')"
    for _ in range(4):
        out = f"regexp_replace({out},'/[^/]+/\\.\\./','/')"
    return out


RESOLVED = f"""res AS (SELECT *, {_resolved("'/data/dems/'||manifest_folder||'/'||working_dem")} AS full_path FROM record),
    norm AS (SELECT *, CASE WHEN starts_with(full_path,'/data/dems/') THEN substr(full_path,12) END AS rel FROM res)"""
STEM = "regexp_replace(regexp_extract({0},'([^/]*)$',1),'^(.+)\\.[^.]*$','\\1')"


@query("S2_catalog_normalise", f"""
    WITH {RESOLVED} SELECT rel AS working_dem, CASE WHEN section<>'' THEN section WHEN contains(rel,'/') THEN split_part(rel,'/',1) ELSE 'dems' END AS section,
           {STEM.format('rel')} AS map_id, site, grp FROM norm WHERE rel IS NOT NULL""", "record")
def catalog_normalise(v: Views):
    out = catalog.normalised(v.record, ROOT)
    return out.where("working_dem is not null").select("working_dem", "section", "map_id", "site", "grp")


@query("S2_layer_paths", f"""
    SELECT page_id, CASE WHEN starts_with(p,'/data/dems/') THEN substr(p,12) END AS nac FROM (SELECT page_id, {_resolved("'/data/dems/host/'||regexp_replace(url,'^https?://','../')")} AS p
      FROM pages)""")
def layer_paths(v: Views):
    path = F.regexp_replace("url", "^https?://", "../")
    records = v.table("pages").select("page_id", F.lit("host").alias("manifest_folder"), path.alias("working_dem"),
                                      F.lit(None).cast("string").alias("section"), F.create_map(F.lit("nac"), path).alias("layers"))
    out = catalog.normalised(records, ROOT).select("page_id", F.col("layers")["nac"].alias("nac"))
    # A trailing slash survives textual replacement but not resolution.
    return out.join(v.table("pages").select("page_id", F.col("url").endswith("/").alias("slash")), "page_id").select(
        "page_id", F.when(F.col("slash"), F.concat("nac", F.lit("/"))).otherwise(F.col("nac")).alias("nac"))


@query("S3_duplicate_ids", f"""
    WITH {RESOLVED} SELECT {STEM.format('rel')} AS map_id, count(*) AS n, min(rel) AS first_location, max(rel) AS last_location FROM norm WHERE rel IS NOT NULL GROUP BY 1 HAVING count(*)>1""", "record")
def duplicate_ids(v: Views):
    return catalog.duplicate_ids(catalog.normalised(v.record, ROOT).where("working_dem is not null"), "working_dem")


@query("S4_path_containment", f"""
    WITH {RESOLVED} SELECT manifest_folder, working_dem AS path,
      CASE WHEN rel IS NULL THEN 'outside' WHEN regexp_matches('/'||rel,'/\\.') THEN 'hidden' END AS catalog_problem,
      CASE WHEN contains(working_dem,'\\') OR contains(working_dem,':') THEN 'invalid' WHEN starts_with(working_dem,'../../') THEN 'outside' WHEN regexp_matches('/'||replace(replace(working_dem,'../',''),'./',''),'/\\.') OR starts_with(working_dem,'.hidden') THEN 'hidden' END AS prepared_problem
    FROM norm""", "record")
def path_containment(v: Views):
    paths = v.record.select(F.col("manifest_folder"), F.col("manifest_folder").alias("folder"), F.col("working_dem").alias("path"))
    return catalog.path_problems(paths, ROOT).drop("folder")


@query("S5_structure_check", """
    SELECT p_partkey, CASE p_size%7 WHEN 1 THEN 'record' WHEN 2 THEN 'working_dem' WHEN 3 THEN 'layers' WHEN 4 THEN 'annotations'
      WHEN 5 THEN 'annotation path' WHEN 6 THEN 'feature_sources' END AS problem FROM part""")
def structure_check(v: Views):
    name = F.col("p_name")
    good = F.to_json(F.struct(name.alias("working_dem"), F.struct(name.alias("nac")).alias("layers"),
                              F.struct(name.alias("painting")).alias("annotations"), F.array(name).alias("feature_sources")))
    kind = F.col("p_size") % 7
    text = (
        F.when(kind == 1, F.to_json(F.array(name)))
        .when(kind == 2, F.to_json(F.struct(F.col("p_size").alias("working_dem"))))
        .when(kind == 3, F.to_json(F.struct(name.alias("working_dem"), F.array(name).alias("layers"))))
        .when(kind == 4, F.to_json(F.struct(name.alias("working_dem"), name.alias("annotations"))))
        .when(kind == 5, F.to_json(F.struct(name.alias("working_dem"), F.struct(F.col("p_size").alias("labels")).alias("annotations"))))
        .when(kind == 6, F.to_json(F.struct(name.alias("working_dem"), F.array("p_size").alias("feature_sources"))))
        .otherwise(good)
    )
    return v.table("part").select("p_partkey", F.parse_json(text).alias("v")).select("p_partkey", catalog.structure_problem().alias("problem"))


@query("S10_file_inventory", """
    SELECT coalesce(d.doc_id,l.doc_id) AS path, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'unlisted' END AS problem
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT CASE WHEN doc_id%5=0 THEN -doc_id-1 ELSE doc_id END AS doc_id FROM labels) l ON d.doc_id=l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def file_inventory(v: Views):
    here = v.table("documents").select(F.col("doc_id").alias("path"))
    listed = F.when(F.col("doc_id") % 5 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))   # some names have no file
    return manifest.inventory_differences(here, v.table("labels").select(listed.alias("path")))


@query("S11_content_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS bytes FROM documents")
def content_digests(v: Views):
    return manifest.digests(v.table("documents"), "text", ["doc_id"]).drop("crc32")


@query("S12_published_checksums", """
    SELECT doc_id AS name, CASE WHEN doc_id%10=3 THEN 'missing' WHEN doc_id%10=4 THEN 'missing' WHEN doc_id%10=5 THEN 'mismatch' ELSE 'ok' END AS status FROM documents""")
def published_checksums(v: Views):
    d = manifest.digests(v.table("documents"), "text", ["doc_id"]).withColumnRenamed("doc_id", "name")
    n = F.col("name") % 10
    published = d.where(n != 3).select(
        "name", F.when(n == 4, F.concat(F.lit("sha1:"), "md5")).when(n == 5, F.concat(F.lit("md5:"), F.reverse("md5")))
        .otherwise(F.concat(F.lit("md5:"), F.upper("md5"))).alias("checksum"))
    return manifest.checksum_status(d, published)


MEMBERS = r"""base AS (SELECT *, regexp_extract(member,'([^/]*)$',1) AS f, regexp_extract(archive,'^A3CLR22_([0-9]+)_',1) AS no, replace(archive,'.zip','') AS folder FROM member),
    kinds AS (SELECT archive, position, member, size, CASE WHEN regexp_matches(f,'^(?i)README(\.(txt|md))?$') THEN 'readme' WHEN lower(f) LIKE '%.csv' AND size<=1048576 THEN 'evidence'
        WHEN regexp_matches(upper(f),'^A3'||lpad(no,CAST(greatest(2,length(no)) AS INT),'0')||'_(GLDOMOS|GLDELEV|GLDMASK|GLDSBCT|GLDBRES|GLDSIGM|GLDISGM)_[0-9]+\.TIF$') THEN
          CASE split_part(upper(f),'_',2) WHEN 'GLDOMOS' THEN 'nac' WHEN 'GLDELEV' THEN 'sfs' WHEN 'GLDMASK' THEN 'image_count' WHEN 'GLDSBCT' THEN 'solar_bins' WHEN 'GLDBRES' THEN 'best_resolution' ELSE 'uncertainty' END END AS kind
      FROM base WHERE (member=f OR member=folder||'/'||f) AND f NOT LIKE '.%'),
    picked AS (SELECT archive, position, member, size, CASE WHEN kind='evidence' THEN 'evidence_'||lpad(CAST(row_number() OVER (PARTITION BY archive, kind ORDER BY position)-1 AS VARCHAR),2,'0') ELSE kind END AS layer FROM kinds WHERE kind IS NOT NULL)"""


@query("S13_archive_members", f"WITH {MEMBERS} SELECT archive, position, member, layer FROM picked", "member")
def archive_members(v: Views):
    return manifest.member_layers(v.member).select("archive", "position", "member", "layer")


@query("S13_archive_problems", f"""
    WITH {MEMBERS} SELECT archive, layer, 'ambiguous' AS problem FROM picked WHERE layer NOT LIKE 'evidence_%' GROUP BY 1,2 HAVING count(*)>1
    UNION ALL SELECT archive, layer, 'missing' FROM (SELECT DISTINCT archive FROM member), (VALUES ('nac'),('sfs'),('image_count'),('readme')) r(layer) WHERE (archive,layer) NOT IN (SELECT (archive,layer) FROM picked)""", "member")
def archive_problems(v: Views):
    return manifest.archive_problems(v.member, manifest.member_layers(v.member))


def counted_tiles(v: Views):
    cut = tiles.with_tiles(v.pixel, 32).withColumn("region", text_id("reg", F.col("map_no")))
    return tiles.tile_counts(cut, ["region", "tile_row", "tile_col"]).withColumn(
        "tile_id", tiles.tile_name(F.col("region"), F.col("tile_row"), F.col("tile_col")))


COUNTED = """counted AS (
    SELECT 'reg'||map_no AS region, 'zenodo-reg'||map_no||'-r'||lpad(CAST(r//32 AS VARCHAR),3,'0')||'-c'||lpad(CAST(c//32 AS VARCHAR),3,'0') AS tile_id,
           max(least(32,height-r//32*32)) AS h, max(least(32,width-c//32*32)) AS w,
           count(sfs) AS valid_count, count(*) FILTER (WHERE sfs IS NOT NULL AND nac IS NOT NULL) AS valid_data_count,
           count(*) FILTER (WHERE sfs IS NOT NULL AND image_count>0) AS sfs_support_count FROM pixel GROUP BY ALL)"""


@query("S15_catalog_records", f"""
    WITH {COUNTED} SELECT tile_id, region AS "group", 'public' AS collection, 'tiles/'||tile_id||'/elevation/'||tile_id||'.tif' AS working_dem, h||'x'||w AS size,
      'image_count=tiles/'||tile_id||'/quality/'||tile_id||'_image_count.tif;nac=tiles/'||tile_id||'/imagery/'||tile_id||'_nac.tif;sfs=tiles/'||tile_id||'/elevation/'||tile_id||'.tif;sfs_support=tiles/'||tile_id||'/quality/'||tile_id||'_sfs_support.tif;valid_data=tiles/'||tile_id||'/quality/'||tile_id||'_valid_data.tif' AS layers,
      valid_count, valid_data_count, sfs_support_count FROM counted""", "pixel")
def catalog_records(v: Views):
    regions = v.shape.select(text_id("reg", F.col("map_no")).alias("region"), "height", "width",
                             F.array(*[F.lit(x) for x in (5.0, 0.0, 0.0, 0.0, -5.0, 0.0)]).alias("transform"))
    laid = tiles.tile_layout(regions, 32).drop("tile_row", "tile_col").join(counted_tiles(v).drop("region"), "tile_id")
    records = catalog.catalog_records(laid, ["sfs", "nac", "image_count", "valid_data", "sfs_support"])
    path = scratch_path(v.spark, "records")
    sinks.write_catalog(records, path)
    out = v.spark.read.schema(records.schema).json(path)
    pairs = F.transform(F.map_entries("layers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("tile_id", "group", "collection", "working_dem",
                      F.array_join(F.transform("size", lambda x: x.cast("string")), "x").alias("size"),
                      F.array_join(pairs, ";").alias("layers"), "valid_count", "valid_data_count", "sfs_support_count")


@query("A12_region_totals", f"WITH {COUNTED} SELECT region, count(*) AS tile_count, CAST(sum(valid_count) AS BIGINT) AS valid_count FROM counted GROUP BY ROLLUP(region)", "pixel")
def region_totals(v: Views):
    return manifest.region_totals(counted_tiles(v))


@query("A12_manifest_consistency", f"""
    WITH {COUNTED}, act AS (SELECT region, count(*) AS actual FROM counted GROUP BY 1), rec AS (SELECT 'reg'||map_no AS region, height//16+map_no%2 AS recorded FROM shape WHERE map_no%5<>4)
    SELECT coalesce(r.region,a.region) AS region, recorded, actual FROM rec r FULL JOIN act a ON r.region=a.region WHERE recorded IS DISTINCT FROM actual""", "pixel shape")
def manifest_consistency(v: Views):
    recorded = v.shape.where("map_no % 5 <> 4").select(text_id("reg", F.col("map_no")).alias("region"), (R.int_div(F.col("height"), 16) + F.col("map_no") % 2).alias("tile_count"))
    return manifest.manifest_problems(recorded, manifest.region_totals(counted_tiles(v)))


@query("T4_region_verification", f"""
    WITH {RECORDED}, {LAYOUT_PROBLEMS}
    SELECT 'layout' AS "check", tile_id AS item, problem FROM layout_problem
    UNION ALL SELECT DISTINCT 'mask', 'map'||map_no, 'differs' FROM pixel WHERE (CASE WHEN r%37=5 AND map_no%3=1 THEN NOT (sfs IS NOT NULL AND nac IS NOT NULL) ELSE (sfs IS NOT NULL AND nac IS NOT NULL) END)<>(sfs IS NOT NULL AND nac IS NOT NULL)
    UNION ALL SELECT 'counts', 'map'||map_no, 'differs' FROM pixel GROUP BY map_no HAVING count(sfs)+CASE WHEN map_no%4=2 THEN 1 ELSE 0 END<>count(sfs)
    UNION ALL SELECT 'files', CAST(coalesce(d.doc_id,l.doc_id) AS VARCHAR), CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'unlisted' END
      FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT CASE WHEN doc_id%5=0 THEN -doc_id-1 ELSE doc_id END AS doc_id FROM labels) l ON d.doc_id=l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
    UNION ALL SELECT 'digest', CAST(doc_id AS VARCHAR), 'modified' FROM documents WHERE doc_id%10=5""", "layout pixel")
def region_verification(v: Views):
    wrong = (F.col("r") % 37 == 5) & (F.col("map_no") % 3 == 1)
    good = R.valid_data("sfs", "nac")
    px = v.pixel.withColumns({
        "valid_data": F.when(wrong, ~good).otherwise(good), "sfs_support": R.sfs_support("sfs", "image_count"),
        "tile_id": text_id("map", F.col("map_no"))})
    stats = grid.layer_stats(v.pixel, ["map_no"], ["sfs"])
    recorded = stats.select("map_no", (F.col("valid") + (F.col("map_no") % 4 == 2).cast("int")).alias("recorded"))
    counts = stats.join(recorded, "map_no").where("valid <> recorded").select(text_id("map", F.col("map_no")).alias("tile_id"))
    bad = published_checksums(v).where("status = 'mismatch'").select(F.col("name").cast("string").alias("path"))
    files = file_inventory(v).withColumn("path", F.col("path").cast("string"))
    return manifest.region_violations(
        tiles.layout_differences(recorded_layout(v), positioned_layout(v)), manifest.mask_differences(px, ["tile_id"]), counts, files, bad)


@query("T6_pending_regions", "SELECT region FROM region_grid WHERE region NOT IN (SELECT 'reg'||s_suppkey FROM supplier WHERE s_acctbal>0)", "region_grid")
def pending_regions(v: Views):
    done = v.table("supplier").where("s_acctbal > 0").select(text_id("reg", F.col("s_suppkey")).alias("region"))
    return manifest.pending_regions(v.region_grid, done)


@query("T6_publication_status", "SELECT count(*) AS requested, count(*) FILTER (WHERE s_acctbal>0) AS published, CASE WHEN count(*)=count(*) FILTER (WHERE s_acctbal>0) THEN 'complete' ELSE 'partial' END AS status FROM supplier")
def publication_status(v: Views):
    done = v.table("supplier").where("s_acctbal > 0").select(text_id("reg", F.col("s_suppkey")).alias("region"))
    return manifest.publication_status(v.region_grid, done)


# -- graphs ------------------------------------------------------------------------

CHAINS = """WITH RECURSIVE link AS (SELECT * FROM edge WHERE grp IS NOT NULL),
    up AS (SELECT alias AS src, alias AS cur, 0 AS d FROM {0} UNION SELECT grp, grp, 0 FROM link UNION ALL SELECT up.src, e.grp, d+1 FROM up JOIN link e ON e.alias=up.cur),
    root AS (SELECT src AS node, arg_max(cur,d) AS root FROM up GROUP BY 1)"""


@query("G2_components", f"{CHAINS.format('link')} SELECT node, min(node) OVER (PARTITION BY root) AS component FROM root", "edge")
def components(v: Views):
    return graph.connected_components(v.edge, "alias", "grp")


@query("G2_alias_groups", f"""{CHAINS.format('edge')}, pr AS (SELECT grp AS node, max(priority) AS p FROM link GROUP BY 1), named AS (SELECT node, root, coalesce(p,0) AS p FROM root LEFT JOIN pr USING (node))
    SELECT node AS alias, first_value(node) OVER (PARTITION BY root ORDER BY p DESC, node) AS canonical FROM named""", "edge")
def alias_groups(v: Views):
    return graph.canonical_names(v.edge)


@query("G3_group_exclusion", """
    WITH RECURSIVE grp AS (SELECT c_custkey AS map_no, c_custkey//5 AS g FROM customer), tl AS (SELECT c_custkey AS map_no, c_custkey*2+3 AS tile FROM customer WHERE c_custkey%3=0),
    reach AS (SELECT c_custkey AS map_no FROM customer WHERE c_custkey%211=17
      UNION SELECT s.m FROM reach r JOIN (SELECT a.map_no AS src, b.map_no AS m FROM grp a JOIN grp b USING (g) UNION ALL SELECT t.tile, b.map_no FROM tl t JOIN grp a USING (map_no) JOIN grp b USING (g)) s ON s.src=r.map_no)
    SELECT DISTINCT map_no FROM reach""")
def group_exclusion(v: Views):
    k = F.col("c_custkey")
    c = v.table("customer")
    groups = c.select(k.alias("map_no"), R.int_div(k, 5).alias("grp"))
    tiles_of = c.where(k % 3 == 0).select(k.alias("map_no"), (k * 2 + 3).alias("tile"))
    return graph.blocked_maps(groups, tiles_of, c.where(k % 211 == 17).select(k.alias("map_no")))


@query("G3_retained_samples", """
    WITH RECURSIVE grp AS (SELECT id AS map_no, id//5 AS g FROM footprint), tl AS (SELECT id AS map_no, id*2+3 AS tile FROM footprint WHERE id%3=0),
    step AS (SELECT a.map_no AS src, b.map_no AS m FROM grp a JOIN grp b USING (g) UNION ALL SELECT t.tile, b.map_no FROM tl t JOIN grp a USING (map_no) JOIN grp b USING (g)),
    one AS (SELECT id AS map_no FROM footprint WHERE id%211=17 UNION SELECT s.m FROM one JOIN step s ON s.src=one.map_no),
    hit AS (SELECT map_no FROM one UNION SELECT a.id FROM footprint a JOIN footprint b ON b.id IN (SELECT map_no FROM one) AND a.crs=b.crs AND a.l<=b.r AND a.r>=b.l AND a.b<=b.t AND a.t>=b.b),
    two AS (SELECT map_no FROM hit UNION SELECT s.m FROM two JOIN step s ON s.src=two.map_no)
    SELECT id AS map_no FROM footprint WHERE id NOT IN (SELECT map_no FROM two)""", "footprint")
def retained_samples(v: Views):
    fp = v.footprint.withColumnRenamed("id", "map_no")
    k = F.col("map_no")
    groups = fp.select("map_no", R.int_div(k, 5).alias("grp"))
    tiles_of = fp.where(k % 3 == 0).select("map_no", (k * 2 + 3).alias("tile"))
    return graph.retained_samples(fp.select("map_no"), groups, tiles_of, fp.where(k % 211 == 17).select("map_no"),
                                  fp.select("map_no", "crs", "l", "b", "r", "t"))


def joined_tiles(v: Views):
    """Suppliers as 64-pixel tiles on a 10-wide lattice with gaps, shifts and a few overlaps."""
    k = F.col("s_suppkey")
    five, zero = F.lit(5.0), F.lit(0.0)
    x = (k % 10) * 64 + F.when(k % 37 == 5, -8).otherwise(0) + F.when(k % 29 == 3, 0.5).otherwise(0.0)
    y = R.int_div(k, 10) * 64
    return v.table("supplier").select(
        k.alias("map_no"), F.when(F.col("s_nationkey") % 4 == 1, F.concat(F.lit("own"), k.cast("string"))).when(k % 23 == 7, "other").otherwise("moon").alias("crs"),
        F.lit(64).cast("bigint").alias("height"), F.when(k % 10 == 9, 20).otherwise(64).cast("bigint").alias("width"),
        F.array(five, zero, (x * 5).cast("double"), zero, -five, (y * -5).cast("double")).alias("transform"))


TILE_SQL = """tile AS (SELECT s_suppkey AS map_no, CASE WHEN s_nationkey%4=1 THEN 'own'||s_suppkey WHEN s_suppkey%23=7 THEN 'other' ELSE 'moon' END||CASE WHEN s_suppkey%29=3 THEN 'h' ELSE '' END AS lat,
      s_suppkey//10*64 AS t, s_suppkey%10*64+CASE WHEN s_suppkey%37=5 THEN -8 ELSE 0 END AS l, s_suppkey//10*64+64 AS b,
      s_suppkey%10*64+CASE WHEN s_suppkey%37=5 THEN -8 ELSE 0 END+CASE WHEN s_suppkey%10=9 THEN 20 ELSE 64 END AS r FROM supplier),
    link AS (SELECT a.map_no AS a, b.map_no AS b, least(a.r,b.r)>greatest(a.l,b.l) AND least(a.b,b.b)>greatest(a.t,b.t) AS clash FROM tile a JOIN tile b ON a.lat=b.lat AND a.map_no<>b.map_no
      AND ((least(a.b,b.b)>greatest(a.t,b.t) AND least(a.r,b.r)>=greatest(a.l,b.l)) OR (least(a.b,b.b)>=greatest(a.t,b.t) AND least(a.r,b.r)>greatest(a.l,b.l))))"""


@query("G4_tile_adjacency", f"WITH {TILE_SQL} SELECT a AS map_no, b AS map_no_2, clash AS overlap FROM link WHERE a<b")
def tile_adjacency(v: Views):
    return graph.tile_adjacency(joined_tiles(v))


@query("G4_tile_contexts", f"""
    WITH RECURSIVE {TILE_SQL}, walk AS (SELECT DISTINCT a AS src, a AS cur FROM link UNION SELECT src, b FROM walk JOIN link ON a=cur),
    comp AS (SELECT src AS map_no, min(cur) AS context FROM walk GROUP BY 1), bad AS (SELECT DISTINCT context FROM comp JOIN link ON a=map_no WHERE clash)
    SELECT map_no, context, t AS top, l AS "left", b-t AS height, r-l AS width FROM comp JOIN tile USING (map_no) WHERE context NOT IN (SELECT context FROM bad)""")
def tile_contexts(v: Views):
    return graph.tile_contexts(joined_tiles(v))


DEPS = """dep AS (SELECT p_partkey AS node, p_partkey//3 AS dep FROM part WHERE p_size>10 AND p_partkey>0 UNION SELECT p_partkey, p_partkey//5 FROM part WHERE p_size%2=0 AND p_partkey>0
    UNION SELECT p_partkey, p_partkey+1 FROM part WHERE p_partkey%211=7 UNION SELECT p_partkey+1, p_partkey FROM part WHERE p_partkey%211=7)"""


def feature_sources(v: Views):
    k, size = F.col("p_partkey"), F.col("p_size")
    part = v.table("part")
    loop = part.where(k % 211 == 7)
    return (
        part.where((size > 10) & (k > 0)).select(k.alias("node"), R.int_div(k, 3).alias("dep"))
        .unionByName(part.where((size % 2 == 0) & (k > 0)).select(k.alias("node"), R.int_div(k, 5).alias("dep")))
        .unionByName(loop.select(k.alias("node"), (k + 1).alias("dep"))).unionByName(loop.select((k + 1).alias("node"), k.alias("dep"))))


@query("G5_dependency_levels", f"""
    WITH RECURSIVE {DEPS}, walk AS (SELECT node, dep AS cur, 1 AS d FROM dep UNION SELECT w.node, e.dep, d+1 FROM walk w JOIN dep e ON e.node=w.cur WHERE d<40),
    cyc AS (SELECT DISTINCT node FROM walk WHERE node=cur), bad AS (SELECT node FROM cyc UNION SELECT node FROM walk WHERE cur IN (SELECT node FROM cyc))
    SELECT n.node, CASE WHEN n.node IN (SELECT node FROM bad) THEN NULL ELSE coalesce((SELECT max(d) FROM walk w WHERE w.node=n.node),0) END AS level
    FROM (SELECT p_partkey AS node FROM part UNION SELECT node FROM dep UNION SELECT dep FROM dep) n""")
def dependency_levels(v: Views):
    return graph.dependency_levels(feature_sources(v), v.table("part").select(F.col("p_partkey").alias("node")))


# -- components of cells, fills --------------------------------------------------------

SUGGESTED = """sug AS (SELECT map_no, ci, cj, CASE WHEN greatest(n1,n2,n3)=0 THEN 0 WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS code FROM (
      SELECT map_no, ((r+1)*16-1)//height AS ci, ((c+1)*16-1)//width AS cj, count(*) FILTER (WHERE pred=1) AS n1, count(*) FILTER (WHERE pred=2) AS n2, count(*) FILTER (WHERE pred=3) AS n3 FROM pixel GROUP BY 1,2,3))"""


def suggested(v: Views):
    return grid.cell_majority(v.pixel, "pred", grid=16, none=0).select("map_no", "ci", "cj", "code")


def _walk(name: str, source: str, value: str) -> str:
    """Reachability inside equal values: brute force, for checking."""
    return f"""{name}_l AS (SELECT a.map_no, a.ci*16+a.cj AS x, b.ci*16+b.cj AS y FROM {source} a JOIN {source} b ON a.map_no=b.map_no AND a.{value}=b.{value} AND abs(a.ci-b.ci)+abs(a.cj-b.cj)=1),
    {name}_w AS (SELECT map_no, ci*16+cj AS x, ci*16+cj AS y FROM {source} WHERE {value} IS NOT NULL UNION SELECT w.map_no, w.x, l.y FROM {name}_w w JOIN {name}_l l ON l.map_no=w.map_no AND l.x=w.y),
    {name} AS (SELECT map_no, x, min(y) AS root, count(*) AS cells FROM {name}_w GROUP BY 1,2)"""


@query("G1_cell_components", f"WITH RECURSIVE {SUGGESTED}, {_walk('comp', 'sug', 'code')} SELECT map_no, x//16 AS ci, x%16 AS cj, root//16 AS ri, root%16 AS rj FROM comp", "pixel")
def cell_components(v: Views):
    return graph.grid_components(suggested(v), "code").drop("value")


@query("G1_blocked_components", f"WITH RECURSIVE {SUGGESTED}, {_walk('comp', 'sug', 'code')} SELECT map_no, x//16 AS ci, x%16 AS cj, root AS root FROM comp", "pixel")
def blocked_components(v: Views):
    """The same components through blocks of five cells that are joined at their borders."""
    parts = graph.grid_components(suggested(v), "code", block=5)
    low = parts.groupBy("map_no", "ri", "rj").agg(F.min(F.col("ci") * 16 + F.col("cj")).alias("root"))
    return parts.join(low, ["map_no", "ri", "rj"]).select("map_no", "ci", "cj", "root")


SEED = "(map_no*5+3)%16*16+(map_no*11+2)%16"


REGION_FILL = f"""
    WITH RECURSIVE {SUGGESTED}, {_walk('comp', 'sug', 'code')},
    reg AS (SELECT s.map_no, s.ci, s.cj, s.code, c.root IN (SELECT root FROM comp k WHERE k.map_no=s.map_no AND k.x={SEED.replace('map_no', 's.map_no')}) AS region FROM sug s JOIN comp c ON c.map_no=s.map_no AND c.x=s.ci*16+s.cj),
    gap AS (SELECT *, CASE WHEN NOT region THEN 1 END AS g FROM reg), {_walk('hole', 'gap', 'g')}
    SELECT reg.map_no, ci, cj, code FROM reg LEFT JOIN hole h ON h.map_no=reg.map_no AND h.x=ci*16+cj WHERE (region OR h.cells<4) AND code>0
      AND reg.map_no IN (SELECT map_no FROM sug WHERE code>0 AND ci*16+cj={SEED})"""


@query("L8_region_fill", REGION_FILL, "pixel")
def region_fill(v: Views):
    m = F.col("map_no")
    seeds = v.maps.select("map_no", ((m * 5 + 3) % 16).alias("ci"), ((m * 11 + 2) % 16).alias("cj"))
    return labels.region_fill(suggested(v), seeds)


@query("L8_guarded_fill", REGION_FILL.replace("SELECT reg.map_no, ci, cj, code FROM reg", """SELECT reg.map_no, ci, cj, code FROM
      (SELECT * FROM reg WHERE NOT EXISTS (SELECT 1 FROM paint p WHERE p.map_no=reg.map_no AND p.ci=reg.ci//2 AND p.cj=reg.cj//2 AND p.code>0 AND NOT p.accepted)
        AND EXISTS (SELECT 1 FROM land l WHERE l.map_no=reg.map_no AND l.ci=reg.ci AND l.cj=reg.cj)) reg""").replace(
      "WITH RECURSIVE", "WITH RECURSIVE land AS (SELECT DISTINCT map_no, ((r+1)*16-1)//height AS ci, ((c+1)*16-1)//width AS cj FROM pixel WHERE z IS NOT NULL),"), "pixel paint")
def guarded_fill(v: Views):
    """The same fill where people may paint: not over hand labels, not where terrain is missing."""
    m = F.col("map_no")
    seeds = v.maps.select("map_no", ((m * 5 + 3) % 16).alias("ci"), ((m * 11 + 2) % 16).alias("cj"))
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    cells = v.paint.withColumn("q", quarter).select(
        "map_no", (F.col("ci") * 2 + F.col("q.i")).alias("ci"), (F.col("cj") * 2 + F.col("q.j")).alias("cj"), "code", "accepted")
    land = grid.paintable_cells(v.pixel, 16).where("paintable")
    return labels.may_fill(labels.region_fill(suggested(v), seeds), cells, land)


@query("L9_loop_fill", f"""
    WITH RECURSIVE {SUGGESTED}, ins AS (SELECT *, ci BETWEEN 3 AND 12 AND cj>=map_no%5 AND cj<14 AS inside FROM sug), hit AS (SELECT *, CASE WHEN inside AND code=2 THEN 1 END AS h FROM ins), {_walk('comp', 'hit', 'h')},
    reg AS (SELECT i.*, coalesce(c.cells>=4,false) AS region FROM ins i LEFT JOIN comp c ON c.map_no=i.map_no AND c.x=i.ci*16+i.cj),
    gap AS (SELECT *, CASE WHEN NOT region THEN 1 END AS g FROM reg), {_walk('hole', 'gap', 'g')}
    SELECT reg.map_no, ci, cj, code FROM reg LEFT JOIN hole h ON h.map_no=reg.map_no AND h.x=ci*16+cj WHERE (region OR (h.cells<4 AND inside)) AND code>0""", "pixel")
def loop_fill(v: Views):
    s = suggested(v)
    inside = s.where((F.col("ci").between(3, 12)) & (F.col("cj") >= F.col("map_no") % 5) & (F.col("cj") < 14))
    return labels.loop_fill(s, inside, 2)
