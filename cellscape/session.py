"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own session."""
    defaults = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else os.cpu_count()),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cellscape")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master may fall back to /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the pixels: both sides are shuffled and merged.

    Files tell little of it (keys and repeated values take next to no room, and an `explode` has
    the size of what it unfolds), so Spark would take millions of rows for a table that is
    small enough to gather in the driver and send to everyone.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so that a lost executor costs no earlier round."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table, next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: dict[str, DataFrame] = {}   # the tables that `stored` has written in this driver, by folder


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_stored(spark: SparkSession) -> None:
    """Delete the tables of `stored`; call it when no result that reads them is needed any more."""
    while _written:
        _delete(spark, _written.popitem()[0])


def drop_stored(*tables: DataFrame) -> None:
    """Delete these tables of `stored`, which nothing that is still to run may read."""
    for path in [p for p, t in _written.items() if any(t is x for x in tables)]:
        _delete(_written.pop(path).sparkSession, path)


def stored(df: DataFrame, name: str = "part", *by: str) -> DataFrame:
    """Write to a fresh table in the shared folder, with a folder per value of `by`, and read it back.

    A lost executor costs no earlier work, and Spark knows the size of the files it reads next
    (not of the rows: see `large`).
    """
    path = scratch_path(df.sparkSession, name)
    (df.hint("rebalance", *by) if by else df).write.partitionBy(*by).parquet(path)
    _written[path] = df.sparkSession.read.schema(df.schema).parquet(path)
    return _written[path]
