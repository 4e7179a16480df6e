"""Writing label maps, paintings, catalogs and reports.

Spark's commit protocol takes the place of staged renames; partition overwrite is
dynamic, so one map's output replaces that map and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.functions.constants import PALETTE, UNKNOWN
from cellscape.functions.raster import restore_missing
from cellscape.operators.labels import stored_flags


def _replace(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    # Rows of one map sit together, so a partition is written by few tasks; AQE splits a
    # map that is far larger than the rest.
    (
        df.hint("rebalance", *keys).write.format(fmt).mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).save(path)
    )


def write_map(px: DataFrame, value: str, path: str) -> None:
    """Labels or predictions per site and map, 255 where unknown."""
    out = px.select("site", "map_no", "r", "c", restore_missing(value, F.lit(UNKNOWN)).cast("smallint").alias("value"))
    _replace(out, path, ["site", "map_no"])


def palette(spark: SparkSession) -> DataFrame:
    """Colour of each code."""
    return spark.createDataFrame([(k, *v) for k, v in PALETTE.items()], "code int, red int, green int, blue int, alpha int")


def write_paintings(cells: DataFrame, path: str) -> None:
    """Codes, approval and certainty replaced together, per source and map."""
    _replace(stored_flags(cells), path, ["source", "map_no"])


def write_catalog(records: DataFrame, path: str) -> None:
    """Catalog records as JSON lines."""
    records.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per run; `report` has one row with run_id and the document."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value"), "run_id").coalesce(1).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").text(path)
