"""Strokes as they arrive: the draft painting follows the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from cellscape.operators.labels import folded_strokes


def follow(strokes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """L5 on a stream: every batch is folded and kept as one part of the painting.

    A part holds one row per cell that its batch painted.  A batch that runs again after a
    failure replaces its own part, so each stroke counts once.
    """
    def keep(batch: DataFrame, number: int) -> None:
        folded_strokes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return strokes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def painting(spark: SparkSession, path: str) -> DataFrame:
    """The painting so far: the parts folded once more, last write first."""
    return folded_strokes(spark.read.parquet(path).drop("batch"))
