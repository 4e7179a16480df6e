"""Training memory: what maps teach, whether that has changed, and how one map is replaced.

Samples lie in a folder per map and version; a manifest names the version of every map that
counts.  A new manifest is written whole and last, so readers see the old memory or the new
one, never a mixture, and a run that dies before it leaves nothing behind that is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.operators import graph
from cellscape.operators.labels import fingerprint
from cellscape.session import stored


def graded_sources(nodes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, links) of `source_revisions`, the same whatever the contents: map_no, level; map_no, source, level.

    Links lie in a folder per level, so that all levels together read them once.
    """
    pairs = stored(sources.select("map_no", "source").distinct(), "links")
    levels = stored(graph.dependency_levels(
        pairs.select(F.col("map_no").alias("node"), F.col("source").alias("dep")), nodes.select(F.col("map_no").alias("node"))
    ).withColumnRenamed("node", "map_no"), "graded")
    return levels, stored(pairs.join(levels.where("level > 0"), "map_no"), "graded_links", "level")


def source_revisions(contents: DataFrame, sources: DataFrame, graded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A digest per map over its own content and everything it takes features from.

    contents: map_no, hash.  sources: map_no, source.  The digest folds the revisions of a map's
    sources, in the order of their ids, behind its own hash, from the leaves up; so a change
    anywhere below shows.  Maps that wait for a cycle, or reach a source without content, have
    a NULL revision.  graded: `graded_sources` of these maps and sources.
    """
    levels, links = graded or graded_sources(contents, sources)
    rows = stored(levels.where("level is not null").join(contents.select("map_no", "hash"), "map_no", "left"), "contents", "level")
    deepest = levels.agg(F.max("level")).first()[0]
    done: list[DataFrame] = []
    for level in range(-1 if deepest is None else deepest + 1):
        own = rows.where(F.col("level") == level).select("map_no", "hash")
        if level:
            known = reduce(DataFrame.unionByName, done).withColumnsRenamed({"map_no": "source", "revision": "below"})
            # As long as the list of sources that a map declares.
            folded = links.where(F.col("level") == level).select("map_no", "source").join(known, "source", "left").groupBy("map_no").agg(
                F.bool_or(F.col("below").isNull()).alias("lost"),
                F.sort_array(F.collect_list(F.struct("source", "below"))).alias("parts"))
            below = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["source"].cast("string"), p["below"])), "|")
            own = own.join(folded, "map_no").select(
                "map_no", F.when(~F.col("lost") & F.col("hash").isNotNull(), F.concat_ws("|", "hash", below)).alias("hash"))
        done.append(stored(own.select("map_no", F.sha2("hash", 256).alias("revision")), "revisions"))
    stuck = levels.where("level is null").select("map_no", F.lit(None).cast("string").alias("revision"))
    return reduce(DataFrame.unionByName, [*done, stuck])


def training_inputs(cells: DataFrame, verified: DataFrame, revisions: DataFrame, grid: int) -> DataFrame:
    """What each verified map would teach now: map_no, painting_hash, source_revision; blank paintings teach nothing."""
    teaching = cells.where("code > 0").select("map_no").distinct().join(verified, "map_no", "left_semi")
    return fingerprint(cells.join(teaching, "map_no", "left_semi"), grid).join(revisions.withColumnRenamed("revision", "source_revision"), "map_no", "left")


def changed_training(current: DataFrame, recorded: DataFrame, schema: str, recorded_schema: str) -> DataFrame:
    """(map_no, status) of maps whose input was added, removed or changed since the last training.

    current, recorded: map_no, painting_hash, source_revision; a legacy record may lack
    columns, which are then not compared.  Under another schema every map is to be read again.
    """
    fields = [c for c in ("painting_hash", "source_revision") if c in recorded.columns]
    a, b = current.select("map_no", F.struct(*fields).alias("now")), recorded.select("map_no", F.struct(*fields).alias("then"))
    status = (
        F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.lit(schema != recorded_schema), "other schema").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    )
    return a.join(b, "map_no", "full_outer").select("map_no", status.alias("status")).where("status is not null")


# -- the stored memory ---------------------------------------------------------


def latest_version(spark: SparkSession, path: str) -> int:
    """The version of the newest manifest; -1 before the first one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return -1
    done = [s.getPath() for s in system.listStatus(folder) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(p.getName()) for p in done), default=-1)


def memory(spark: SparkSession, path: str) -> DataFrame:
    """The samples that the newest manifest names."""
    manifest = spark.read.parquet(f"{path}/manifest/{latest_version(spark, path)}")
    return spark.read.parquet(f"{path}/samples").join(manifest, ["map_no", "version"], "left_semi").drop("version")


def publish(path: str, fresh: DataFrame, kept: DataFrame) -> int:
    """Write the fresh samples under a new version and a manifest of them and the kept maps; returns the version.

    fresh: samples.  kept: map_no and version, from the manifest before.
    """
    spark = fresh.sparkSession
    version = latest_version(spark, path) + 1
    fresh = stored(fresh.withColumn("version", F.lit(version)), "fresh")
    # A task that is tried again writes its files anew; a failed run's version is never named.
    fresh.hint("rebalance", "map_no").write.mode("append").partitionBy("map_no", "version").parquet(f"{path}/samples")
    # A row per map.
    kept.select("map_no", "version").unionByName(fresh.select("map_no", "version").distinct()).coalesce(1).write.parquet(f"{path}/manifest/{version}")
    return version


def updated(path: str, asked: DataFrame, fresh: DataFrame, verified: DataFrame, held: DataFrame, groups: DataFrame,
            tiles: DataFrame, footprints: DataFrame) -> DataFrame:
    """M6: replace the samples of the asked maps, then drop whatever may no longer teach.

    asked: map_no.  fresh: samples of asked maps; an asked map without any is forgotten.
    verified, held: map_no.  groups, tiles, footprints: as `graph.retained_samples` takes them.
    Old and new samples go through the exclusion together, so that an alias only the old ones
    know still counts.  Refused maps teach nothing, not even what was remembered.  Publishes the new
    memory and returns (map_no, status) of every map: refused, replaced, added, forgotten,
    dropped or kept.
    """
    spark = asked.sparkSession
    before = latest_version(spark, path)
    schema = f"map_no {fresh.schema['map_no'].dataType.simpleString()}, version int"
    old = stored((spark.read.parquet(f"{path}/manifest/{before}") if before >= 0 else spark.createDataFrame([], schema)), "old")
    new = stored(fresh.join(asked, "map_no", "left_semi"), "new")
    maps = stored(old.select("map_no").unionByName(asked.select("map_no")).distinct(), "maps")
    clear = graph.retained_samples(maps, groups, tiles, held, footprints).withColumn("clear", F.lit(True))
    flag = lambda df, name: df.select("map_no").distinct().withColumn(name, F.lit(True))
    state = maps
    for marked in (flag(asked, "asked"), flag(new, "fresh"), flag(old, "old"), flag(verified, "verified"), flag(held, "held"), clear):
        state = state.join(marked, "map_no", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(on("asked") & on("held"), "refused: held out").when(on("asked") & ~on("verified"), "refused: not verified")
        .when(on("asked") & on("fresh") & ~on("clear"), "refused: excluded geography")
        .when(on("asked") & ~on("fresh"), "forgotten").when(on("asked") & on("old"), "replaced").when(on("asked"), "added")
        .when(on("held") | ~on("clear"), "dropped: excluded").when(~on("verified"), "dropped: not verified").otherwise("kept")
    )
    told = stored(state.select("map_no", status.alias("status")), "told")
    goes_in = told.where("status in ('replaced', 'added')").select("map_no")
    publish(path, new.join(goes_in, "map_no", "left_semi"), old.join(told.where("status = 'kept'").select("map_no"), "map_no", "left_semi"))
    return told
