"""Archive members, inventories, digests and publication state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscape.functions.constants import (
    ARCHIVE_NAME,
    PRODUCT_LAYER,
    REQUIRED_MEMBERS,
)


def digests(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """SHA-256, MD5, CRC-32 and size of every file, in one projection.

    content: BINARY (`binaryFile`) or text.
    """
    raw = F.col(content).cast("binary")
    return files.select(
        *keep, F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), F.crc32(raw).alias("crc32"),
        F.octet_length(raw).cast("bigint").alias("bytes"),
    )


def inventory_differences(present: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Files that are missing or unlisted."""
    a = present.select(key).distinct().withColumn("here", F.lit(True))
    b = expected.select(key).distinct().withColumn("listed", F.lit(True))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("here").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def checksum_status(archives: DataFrame, published: DataFrame) -> DataFrame:
    """Archives against the published `md5:<hex>` list.  Both: name, checksum side."""
    joined = archives.select("name", "md5").join(published.select("name", "checksum"), "name", "left")
    status = (
        F.when(F.col("checksum").isNull() | ~F.col("checksum").rlike("^md5:[0-9a-fA-F]{32}$"), "missing")
        .when(F.lower(F.substring("checksum", 5, 32)) != F.col("md5"), "mismatch")
        .otherwise("ok")
    )
    return joined.select("name", status.alias("status"))


def member_layers(members: DataFrame) -> DataFrame:
    """What each archive member is, and the archive's evidence numbering.

    members: archive, position, member, size.  Only files at the top level, or in the one
    folder named like the archive, can be a product.
    """
    named = members.withColumns({
        "_no": F.regexp_extract("archive", ARCHIVE_NAME, 1),
        "_base": F.regexp_extract("member", r"([^/]*)$", 1),
        "_folder": F.regexp_replace("archive", r"\.zip$", ""),
    })
    base = F.col("_base")
    direct = (F.col("member") == base) | (F.col("member") == F.concat_ws("/", "_folder", base))
    usable = named.where(direct & (F.col("_no") != "") & ~base.startswith(".") & (F.col("_folder") != "__MACOSX"))
    coded = usable.withColumn("_code", F.regexp_extract(F.upper("_base"), r"^(A3\d+_[A-Z]+)_\d+\.TIF$", 1)).withColumn(
        "_roi", F.format_string("A3%02d_", F.col("_no").cast("int"))
    )
    layers = F.create_map(*[F.lit(x) for pair in PRODUCT_LAYER.items() for x in pair])
    product = F.when(F.col("_code").startswith(F.col("_roi")), F.try_element_at(layers, F.element_at(F.split("_code", "_"), -1)))
    kind = (
        F.when(base.rlike(r"(?i)^README(\.(txt|md))?$"), "readme")
        .when(F.lower(base).endswith(".csv") & (F.col("size") <= 1024 * 1024), "evidence")
        .otherwise(product)
    )
    picked = coded.select("archive", "position", "member", "size", kind.alias("layer")).where("layer is not null")
    # An archive lists at most 100,000 entries, so its window is bounded.
    number = F.row_number().over(Window.partitionBy("archive", "layer").orderBy("position")) - 1
    return picked.withColumn("_n", number).withColumn(
        "layer", F.when(F.col("layer") == "evidence", F.format_string("evidence_%02d", F.col("_n").cast("int"))).otherwise(F.col("layer"))
    ).drop("_n")


def archive_problems(archives: DataFrame, layers: DataFrame) -> DataFrame:
    """Ambiguous products and missing required ones, per archive."""
    found = layers.where("not startswith(layer, 'evidence_')").groupBy("archive", "layer").agg(F.count(F.lit(1)).alias("n"))
    ambiguous = found.where("n > 1").select("archive", "layer", F.lit("ambiguous").alias("problem"))
    required = archives.select("archive").distinct().select(
        "archive", F.explode(F.array(*[F.lit(x) for x in REQUIRED_MEMBERS])).alias("layer")
    )
    missing = required.join(found, ["archive", "layer"], "left_anti").withColumn("problem", F.lit("missing"))
    return ambiguous.unionByName(missing)


def region_totals(tiles: DataFrame) -> DataFrame:
    """Tiles and valid pixels per region with the grand total (NULL region)."""
    return tiles.rollup("region").agg(
        F.count(F.lit(1)).alias("tile_count"), F.sum("valid_count").alias("valid_count")
    )


def manifest_problems(regions: DataFrame, totals: DataFrame) -> DataFrame:
    """Recorded tile counts against the tiles themselves.  regions: region, tile_count."""
    a = regions.select("region", F.col("tile_count").alias("recorded"))
    b = totals.where("region is not null").select("region", F.col("tile_count").alias("actual"))
    return a.join(b, "region", "full_outer").where(~F.col("recorded").eqNullSafe(F.col("actual")))


def pending_regions(requested: DataFrame, published: DataFrame) -> DataFrame:
    """Regions still to build."""
    return requested.select("region").distinct().join(published.select("region"), "region", "left_anti")


def publication_status(requested: DataFrame, published: DataFrame) -> DataFrame:
    """Complete once every requested region is published, else partial."""
    n = requested.select("region").distinct().join(
        published.select("region").distinct().withColumn("done", F.lit(True)), "region", "left"
    )
    return n.agg(
        F.count(F.lit(1)).alias("requested"), F.count("done").alias("published"),
        F.when(F.count(F.lit(1)) == F.count("done"), "complete").otherwise("partial").alias("status"),
    )


def region_violations(layout: DataFrame, masks: DataFrame, counts: DataFrame, files: DataFrame, digest: DataFrame) -> DataFrame:
    """T4: everything wrong with a region in one table (check, item, problem); empty = valid.

    layout: T3 rows.  masks: tile_id of tiles with a mask that differs.  counts: tile_id of
    tiles whose recorded counts differ.  files: S10 rows.  digest: path of modified files.
    """
    return (
        layout.select(F.lit("layout").alias("check"), F.col("tile_id").alias("item"), "problem")
        .unionByName(masks.select(F.lit("mask").alias("check"), F.col("tile_id").alias("item"), F.lit("differs").alias("problem")))
        .unionByName(counts.select(F.lit("counts").alias("check"), F.col("tile_id").alias("item"), F.lit("differs").alias("problem")))
        .unionByName(files.select(F.lit("files").alias("check"), F.col("path").alias("item"), "problem"))
        .unionByName(digest.select(F.lit("digest").alias("check"), F.col("path").alias("item"), F.lit("modified").alias("problem")))
    )


def mask_differences(px: DataFrame, keys: list[str]) -> DataFrame:
    """T4: tiles whose stored masks disagree with the layers they come from."""
    from cellscape.functions.raster import sfs_support, valid_data

    wrong = (F.col("valid_data") != valid_data("sfs", "nac")) | (F.col("sfs_support") != sfs_support("sfs", "image_count"))
    return px.groupBy(*keys).agg(F.count_if(wrong).alias("n")).where("n > 0").drop("n")
