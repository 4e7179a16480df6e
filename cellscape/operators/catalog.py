"""Catalog records: normalise, check, look up and list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions import paths as P


def normalised(records: DataFrame, root: str) -> DataFrame:
    """Paths relative to the root, the map id and the section.

    records: manifest_folder (relative), working_dem, section, layers MAP<STRING,STRING>.
    """
    root_name = root.rstrip("/").rsplit("/", 1)[-1]

    def relative(value: Column) -> Column:
        return P.relative_parts(P.resolve(P.absolute(root, "manifest_folder", value)), root)

    parts = relative(F.col("working_dem"))
    out = records.withColumn("_parts", parts).withColumn("working_dem", F.array_join("_parts", "/"))
    out = out.withColumn("section", F.coalesce(F.nullif("section", F.lit("")), P.first_folder(F.col("_parts"), root_name)))
    if "layers" in records.columns:
        out = out.withColumn("layers", F.transform_values("layers", lambda _, v: F.array_join(relative(v), "/")))
    return out.withColumn("map_id", P.stem("working_dem")).drop("_parts")


def path_problems(paths: DataFrame, root: str) -> DataFrame:
    """Both containment rules side by side.  paths: folder, path."""
    return paths.select(
        "*",
        P.catalog_path_problem(root, "folder", "path").alias("catalog_problem"),
        P.prepared_path_problem("folder", "path").alias("prepared_problem"),
    )


def duplicate_ids(records: DataFrame, location: str) -> DataFrame:
    """S3: map ids registered more than once, naming the first and the last location.

    A count and two extremes, so an id with any number of copies stays one small row.
    """
    return records.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(location).alias("first_location"), F.max(location).alias("last_location")
    ).where("n > 1")


def structure_problem() -> Column:
    """Why a raw catalog record (VARIANT column `v`) is refused, or NULL."""
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    def absent(path: str) -> Column:
        k = kind(path)
        return k.isNull() | (k == "VOID")

    def text_or_none(path: str) -> Column:
        return absent(path) | (kind(path) == "STRING")

    bad_annotation = F.lit(False)
    for name in ("painting", "confidence", "accepted", "labels"):
        bad_annotation = bad_annotation | ~text_or_none(f"$.annotations.{name}")
    # schema_of_variant has no element type for an empty list.
    sources = kind("$.feature_sources")
    return (
        F.when(~F.schema_of_variant("v").startswith("OBJECT"), "record")
        .when(absent("$.working_dem") | (kind("$.working_dem") != "STRING"), "working_dem")
        .when(~absent("$.layers") & ~kind("$.layers").startswith("OBJECT"), "layers")
        .when(~absent("$.annotations") & ~kind("$.annotations").startswith("OBJECT"), "annotations")
        .when(bad_annotation, "annotation path")
        .when(~absent("$.feature_sources") & ~sources.isin("ARRAY<STRING>", "ARRAY<VOID>"), "feature_sources")
    )


def looked_up(names: DataFrame, records: DataFrame) -> DataFrame:
    """Each asked name by its exact id, else by its stem, with site and group.

    Both attempts are keys of one join: a name offers (id, rank 0) and (stem, rank 1).
    """
    asked = names.select("name", F.explode(F.array(
        F.struct(F.col("name").alias("map_id"), F.lit(0).alias("rank")),
        F.struct(P.stem("name").alias("map_id"), F.lit(1).alias("rank")),
    )).alias("k")).select("name", "k.map_id", "k.rank")
    found = asked.join(records.select("map_id", "site", "grp"), "map_id").groupBy("name").agg(
        F.min_by(F.struct("map_id", "site", "grp"), "rank").alias("hit")
    )
    return names.select("name").distinct().join(found, "name", "left").select(
        "name", "hit.map_id", F.coalesce("hit.grp", "hit.site").alias("site_group"),
    )


def companions(records: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """A map's companion: the registered layer if that file exists, else a neighbour
    file <stem>_<kind> with a TIFF suffix.

    records: map_id, working_dem, layer (path or NULL).  files: path.
    """
    base = F.regexp_replace("working_dem", r"\.[^./]*$", "")
    offers = F.array(
        F.struct(F.col("layer").alias("path"), F.lit(0).alias("rank")),
        *[F.struct(F.concat(base, F.lit(f"_{kind}{ext}")).alias("path"), F.lit(i + 1).alias("rank"))
          for i, ext in enumerate((".tif", ".tiff", ".TIF", ".TIFF"))],
    )
    offered = records.select("map_id", F.explode(offers).alias("o")).select("map_id", "o.path", "o.rank").where("path is not null")
    have = offered.join(files.select("path"), "path", "left_semi")
    best = have.groupBy("map_id").agg(F.min_by("path", "rank").alias("companion"))
    return records.select("map_id").join(best, "map_id", "left")


def listed(names: DataFrame, maps: DataFrame) -> DataFrame:
    """The named maps that exist, in the order they are named.  names: map_no, position."""
    return names.join(maps.select("map_no"), "map_no", "left_semi").orderBy("position")


def map_listing(maps: DataFrame, painted: DataFrame, saved: DataFrame, meta: DataFrame, exports: DataFrame) -> DataFrame:
    """The gallery's row per map: section, verification, painted, saved, labelled.

    painted/saved: map_no of effective and of saved paintings.  exports: map_no with a
    stored label raster.
    """
    verified = meta.where("key = 'verified' and value = 'true'").select("map_no", F.lit(True).alias("verified"))
    flag = F.lit(True)
    return (
        maps.select("map_no", "section")
        .join(verified, "map_no", "left")
        .join(painted.select("map_no").distinct().withColumn("painted", flag), "map_no", "left")
        .join(saved.select("map_no").distinct().withColumn("saved", flag), "map_no", "left")
        .join(exports.select("map_no").distinct().withColumn("exported", flag), "map_no", "left")
        .fillna(False, ["verified", "painted", "saved", "exported"])
        .withColumn("labelled", F.col("painted") | F.col("exported"))
    )


def gallery(listing: DataFrame, section: str | None = None, status: str = "all") -> DataFrame:
    """Section filter and `all`, `verified` or `saved-unverified`."""
    out = listing if section is None else listing.where(F.col("section") == section)
    if status == "verified":
        return out.where("verified")
    if status == "saved-unverified":
        return out.where("saved and not verified")
    return out


def selection_counts(listing: DataFrame) -> DataFrame:
    """Maps and verified maps of a selection."""
    return listing.agg(F.count(F.lit(1)).alias("maps"), F.count_if("verified").alias("verified"))


def with_labels(maps: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether a map has any labelled cell; a semi join needs no count."""
    some = cells.where("code in (1, 2, 3)").select("map_no")
    return maps.select("map_no").join(some.distinct().withColumn("has_labels", F.lit(True)), "map_no", "left").fillna(False, ["has_labels"])


def seeded_paintings(bundled: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Bundled, non-empty paintings of maps without any artifact go to both buckets."""
    fresh = bundled.join(artifacts.select("map_no"), "map_no", "left_anti")
    painted = fresh.where("code > 0").select("map_no").distinct()
    kept = fresh.join(painted, "map_no", "left_semi")
    return kept.withColumn("bucket", F.explode(F.array(F.lit("saved"), F.lit("draft"))))


def disagreement(px: DataFrame, prediction: str, label: str) -> DataFrame:
    """Pixels whose label and prediction are both known and differ."""
    return px.where(F.col(prediction).isin(1, 2, 3) & F.col(label).isin(1, 2, 3) & (F.col(prediction) != F.col(label)))


# Where a tile's layers are, apart from the quality layers.
LAYER_PATH = {"sfs": "elevation/{tile}", "nac": "imagery/{tile}_nac"}


def catalog_records(tiles: DataFrame, layers: list[str]) -> DataFrame:
    """One JSON record per tile with its layer paths and counts.

    tiles: region, tile_id, tile_height, tile_width, transform and the three counts.
    """
    def path(layer: str) -> Column:
        place = LAYER_PATH.get(layer, "quality/{tile}_" + layer)
        return F.concat(F.lit("tiles/"), F.col("tile_id"), F.lit("/"), F.replace(F.lit(place), F.lit("{tile}"), F.col("tile_id")), F.lit(".tif"))

    ordered = sorted(layers)
    return tiles.select(
        path("sfs").alias("working_dem"), "tile_id", F.col("region").alias("group"), F.col("region").alias("site"),
        F.lit("public").alias("collection"), F.array("tile_height", "tile_width").alias("size"), "transform",
        F.map_from_arrays(F.array(*[F.lit(x) for x in ordered]), F.array(*[path(x) for x in ordered])).alias("layers"),
        "valid_count", "valid_data_count", "sfs_support_count",
    )
