"""Catalog and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.functions.constants import REPORT_NAME


def manifest_listing(spark: SparkSession, root: str, name: str = "working_dems.json") -> DataFrame:
    """Every published catalog under the root, whole text per file.

    Hidden folders are left out; the depth comes along for the reading order.
    """
    root = root.rstrip("/")
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    )
    plain = F.regexp_replace("file", r"^file:/*", "/")
    rel = F.substring(plain, F.lit(len(root) + 2), F.length(plain))
    parts = F.split(rel, "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith("."))
    return raw.select(
        "value", rel.alias("manifest"), F.size(parts).alias("depth"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("manifest_folder"), hidden.alias("hidden"),
    ).where(~F.col("hidden")).drop("hidden")


def raw_records(listing: DataFrame) -> DataFrame:
    """Catalog entries as VARIANT, in reading order; unreadable or non-list files and
    entries without a textual working_dem are skipped."""
    parsed = listing.select("manifest", "depth", "manifest_folder", F.try_parse_json("value").alias("doc"))
    listed = parsed.where(F.schema_of_variant("doc").startswith("ARRAY"))
    entries = listed.select(
        "manifest", "depth", "manifest_folder", F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("position", "v")
    )
    return entries.where(F.schema_of_variant(F.try_variant_get("v", "$.working_dem", "variant")) == "STRING")


def records(listing: DataFrame) -> DataFrame:
    """Typed catalog records: D7 with its nullable extras."""
    def text(path: str) -> Column:
        return F.try_variant_get("v", path, "string")

    return raw_records(listing).select(
        "manifest", "depth", "position", "manifest_folder",
        text("$.working_dem").alias("working_dem"), text("$.section").alias("section"),
        text("$.site").alias("site"), text("$.group").alias("grp"), text("$.collection").alias("collection"),
        F.try_variant_get("v", "$.size", "array<bigint>").alias("size"),
        F.try_variant_get("v", "$.transform", "array<double>").alias("transform"),
        F.try_variant_get("v", "$.layers", "map<string,string>").alias("layers"),
        F.try_variant_get("v", "$.feature_sources", "array<string>").alias("feature_sources"),
        F.try_variant_get("v", "$.annotations.painting", "string").alias("painting"),
        F.try_variant_get("v", "$.annotations.labels", "string").alias("labels"),
        F.try_variant_get("v", "$.annotations.verified", "boolean").alias("verified"),
    )


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation reports of a folder: run_id from the file name, and the text."""
    return spark.read.option("pathGlobFilter", "evaluation-*.json").text(folder, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", REPORT_NAME, 1).alias("run_id"), "value"
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest valid report; a corrupt newer one never hides an older valid one.

    Lists are checked to the last element: map names are text, tiles, skips and folds objects.

    reports: run_id (dated, so that text order is time order), value (JSON text).
    """
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("doc", path, "variant"))

    def absent(path: str) -> Column:
        return kind(path).isNull() | (kind(path) == "VOID")

    def number(path: str) -> Column:
        return F.try_variant_get("doc", path, "double")

    def share(path: str) -> Column:
        numeric = kind(path).isin("BIGINT", "DOUBLE") | kind(path).startswith("DECIMAL")
        return absent(path) | F.coalesce(numeric & number(path).between(0, 1), F.lit(False))

    stamp = F.try_to_timestamp(F.substring("run_id", 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    valid = (
        (F.col("run_id") != "") & stamp.isNotNull()
        & (F.try_variant_get("doc", "$.run_id", "string") == F.col("run_id"))
        & (kind("$.validation.aggregate.n") == "BIGINT") & (number("$.validation.aggregate.n") > 0)
        & kind("$.provenance.maps").startswith("OBJECT")
    )
    for block in ("aggregate", "baseline_aggregate"):
        for name in ("accuracy", "macro_f1"):
            valid = valid & share(f"$.validation.{block}.{name}")
    valid = valid & kind("$.validation.aggregate").startswith("OBJECT")
    valid = valid & (kind("$.validation.baseline_aggregate").isNull() | kind("$.validation.baseline_aggregate").startswith("OBJECT"))
    for path, element in (("$.selected_maps", "STRING"), ("$.tiles", "OBJECT"), ("$.skipped", "OBJECT"), ("$.validation.folds", "OBJECT")):
        parts = F.try_variant_get("doc", path, "array<variant>")
        sound = F.forall(parts, lambda x: F.startswith(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), F.lit(element)))
        valid = valid & (kind(path).isNull() | (kind(path).startswith("ARRAY") & F.coalesce(sound, F.lit(False))))
    good = reports.withColumn("doc", F.try_parse_json("value")).where(valid)
    return good.agg(F.max("run_id").alias("run_id"), F.max_by("value", "run_id").alias("report")).where("run_id is not null")
