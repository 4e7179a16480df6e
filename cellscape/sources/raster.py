"""Pixel tables: reading, cleaning and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.functions.raster import clean_read


def pixels(spark: SparkSession, path: str, layers: dict[str, float | None]) -> DataFrame:
    """A pixel Parquet table with the nodata value of each layer turned into NULL."""
    raw = spark.read.parquet(path)
    return raw.withColumns({name: clean_read(name, nodata) for name, nodata in layers.items()})


def from_rows(rows: DataFrame, values: str, keys: list[str]) -> DataFrame:
    """One array per raster row to one row per pixel."""
    return rows.select(*keys, F.posexplode(values).alias("c", "v")).withColumn("c", F.col("c").cast("bigint"))


def to_rows(px: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Pixels back to one array per raster row; a row is bounded by the raster width."""
    packed = F.array_sort(F.collect_list(F.struct("c", F.col(value).alias("v"))))
    return px.groupBy(*keys).agg(F.transform(packed, lambda p: p["v"]).alias("values"))


def layer_sources(spark: SparkSession, path: str) -> DataFrame:
    """Header records of the native layers: grid, type, nodata, scale and tags are
    kept as they are; a scale is never applied to samples."""
    return spark.read.schema(
        "map_id string, layer string, "
        "grid struct<width:int,height:int,transform:array<double>,crs_wkt:string,spacing:array<double>>, "
        "dtype string, nodata string, scales array<double>, offsets array<double>, units array<string>, "
        "tags map<string,string>, band_tags map<string,string>, descriptions array<string>, mask_flags array<array<string>>"
    ).json(path)


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, length and content of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
