"""Catalog files, reports, models, sinks, checkpoints and the stroke stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cellscape import session
from cellscape.operators import catalog as ops
from cellscape.operators import model
from cellscape.sources import catalog, raster, sinks


def write(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def test_catalog_scan_order_and_skips(spark, tmp_path):
    root = str(tmp_path / "dems")
    write(f"{root}/deep/er/working_dems.json", [{"working_dem": "c.tif"}])
    write(f"{root}/b/working_dems.json", [{"working_dem": "x/b.tif", "site": "s", "size": [3, 4], "layers": {"nac": "n.tif"}}, {"site": 1}, 7])
    write(f"{root}/a/working_dems.json", [{"working_dem": "a.tif", "feature_sources": ["../b/x/b.tif"]}])
    write(f"{root}/.staging/working_dems.json", [{"working_dem": "hidden.tif"}])
    write(f"{root}/broken/working_dems.json", "[{")
    write(f"{root}/object/working_dems.json", {"working_dem": "o.tif"})
    write(f"{root}/a/other.json", [{"working_dem": "no.tif"}])
    records = catalog.records(catalog.manifest_listing(spark, root))
    got = records.orderBy("depth", "manifest", "position").collect()
    assert [r["working_dem"] for r in got] == ["a.tif", "x/b.tif", "c.tif"]
    assert got[1]["size"] == [3, 4] and got[0]["feature_sources"] == ["../b/x/b.tif"]
    named = {r["map_id"]: (r["working_dem"], r["section"]) for r in ops.normalised(records, root).collect()}
    assert named == {"a": ("a/a.tif", "a"), "b": ("b/x/b.tif", "b"), "c": ("deep/er/c.tif", "deep")}


def report(run, n=5, accuracy=0.5, **more):
    return {"run_id": run, "validation": {"aggregate": {"n": n, "accuracy": accuracy}, **more}, "provenance": {"maps": {}}}


def test_latest_report_never_hides_an_older_valid_one(spark, tmp_path):
    folder = str(tmp_path / "evaluations")
    ids = [f"2026010{d}T000000.000000Z-0000000{d}" for d in range(1, 8)]
    write(f"{folder}/evaluation-{ids[0]}.json", report(ids[0]))
    write(f"{folder}/evaluation-{ids[1]}.json", report(ids[1], accuracy=None))
    write(f"{folder}/evaluation-{ids[2]}.json", report(ids[2], n=0))
    write(f"{folder}/evaluation-{ids[3]}.json", report(ids[3], accuracy=1.5))
    write(f"{folder}/evaluation-{ids[4]}.json", report("someone else"))
    write(f"{folder}/evaluation-{ids[5]}.json", "{")
    write(f"{folder}/evaluation-{ids[6]}.json", report(ids[6], folds="none"))
    write(f"{folder}/evaluation-20269999T000000.000000Z-00000009.json", report("20269999T000000.000000Z-00000009"))
    write(f"{folder}/evaluation-note.json", report("note"))
    got = catalog.latest_report(catalog.report_files(spark, folder)).collect()
    assert [r["run_id"] for r in got] == [ids[1]]


def test_files_and_digests(spark, tmp_path):
    import hashlib

    from cellscape.operators.manifest import digests

    write(str(tmp_path / "in/a.txt"), "hello")
    row = digests(raster.files(spark, str(tmp_path / "in")), "content", ["path"]).first()
    assert row["sha256"] == hashlib.sha256(b"hello").hexdigest() and row["bytes"] == 5


FEATURES = "map_no bigint, r bigint, c bigint, label int, w double, slope double, rough double, svf double, rel_local double, curv double, svf_local double"


def rows(n=60):
    return [(0, i, 0, 1 + i % 2, 1.0, float(i % 2), 0.1 * i, 0.0, 1.0, 2.0, 3.0) for i in range(n)]


def test_features_fixed_order(spark):
    df = spark.createDataFrame(rows(), FEATURES)
    assert model.base_features(df.select("map_no", "svf_local", "curv", "rel_local", "svf", "rough", "slope")).columns[1:] == list(model.K.BASE_FEATURES)
    with pytest.raises(ValueError, match="missing"):
        model.base_features(df.drop("curv"))
    with pytest.raises(ValueError, match="doubled"):
        model.base_features(df.select("*", "curv"))


def test_model_schema_gate(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(), FEATURES)
    fitted = model.fit(df, model.forest(num_trees=20, max_depth=4))
    path = str(tmp_path / "m")
    model.save(fitted, path)
    again = model.predict(model.load(path), df)
    assert again.where("prediction = label").count() == 60
    monkeypatch.setattr(model.K, "FEATURE_VERSION", model.K.FEATURE_VERSION + 1)
    assert model.load(path) is None                      # the previous recipe asks for a retrain
    monkeypatch.setattr(model.K, "FEATURE_VERSION", model.K.FEATURE_VERSION + 1)
    with pytest.raises(ValueError):
        model.load(path)


def test_missing_features_are_not_predicted(spark):
    df = spark.createDataFrame(rows(), FEATURES)
    fitted = model.fit(df, model.forest(num_trees=2, max_depth=2))
    holes = df.withColumn("rough", F.when(F.col("r") % 3 != 0, F.col("rough")))
    got = model.predict(fitted, holes)
    assert got.count() == 60 and got.where("prediction is null and confidence is null").count() == 20
    assert got.where("confidence < 1/3 - 1e-9").count() == 0


def test_one_unit_and_no_rows(spark):
    df = spark.createDataFrame(rows(), FEATURES).where("label = 2")
    got = model.predict(model.fit(df, model.forest()), df)
    assert {(r["prediction"], r["confidence"]) for r in got.select("prediction", "confidence").collect()} == {(2, 1.0)}
    none = model.fit(df.where("false"), model.forest())
    assert none.model is None and none.only is None


def test_boosting_confidence_is_a_share(spark):
    df = spark.createDataFrame(rows(120), FEATURES).withColumn("label", (1 + F.col("r") % 3).cast("int"))
    got = model.predict(model.fit(df, model.boosting(rounds=2, max_depth=2)), df)
    assert got.where("confidence between 1/3 - 1e-9 and 1").count() == 120


def test_held_out_map_is_refused(spark):
    df = spark.createDataFrame(rows(), FEATURES)
    with pytest.raises(ValueError, match="held out"):
        model.replaced_samples(df, df, 0, spark.createDataFrame([(0,)], "map_no bigint"))


def test_map_sink_replaces_one_map_only(spark, tmp_path):
    path = str(tmp_path / "maps")
    px = spark.range(20).select((F.col("id") % 2).alias("map_no"), F.lit("s").alias("site"), F.col("id").alias("r"), F.lit(0).alias("c"),
                                F.when(F.col("id") > 3, 1).alias("label"))
    sinks.write_map(px, "label", path)
    sinks.write_map(px.where("map_no = 1").withColumn("label", F.lit(3)), "label", path)
    got = {(r["map_no"], r["value"]): r["count"] for r in spark.read.parquet(path).groupBy("map_no", "value").count().collect()}
    assert got == {(0, 255): 2, (0, 1): 8, (1, 3): 10}


def test_checkpoint_folder_comes_from_the_session(spark):
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())


def test_stored_tables_can_be_cleared(spark):
    kept = session.stored(spark.range(3).toDF("x"))
    assert sorted(r.x for r in kept.collect()) == [0, 1, 2]
    there = lambda: [os.path.exists(p.removeprefix("file:")) for p in paths]
    gone = session.stored(spark.range(2).toDF("x"))
    paths = list(session._written)[-2:]
    session.drop_stored(gone, gone, spark.range(1))          # what is not stored, or no longer, is left alone
    assert there() == [True, False] and kept.count() == 3
    session.clear_stored(spark)
    assert not session._written and there() == [False, False]


def test_stroke_stream_equals_the_batch_fold(spark, tmp_path):
    from cellscape.operators.labels import folded_strokes
    from cellscape.streaming.strokes import follow, painting

    folder = str(tmp_path / "log")
    log = spark.range(200).select((F.col("id") % 3).alias("map_no"), (F.col("id") * 7 % 10).alias("cell"), F.col("id").alias("seq"),
                                  (F.col("id") % 4).cast("int").alias("code"), F.lit(2).alias("conf"), (F.col("id") % 5 == 0).alias("accepted"))
    log.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    running = follow(stream, str(tmp_path / "parts"), str(tmp_path / "state"))
    try:
        running.processAllAvailable()
        assert sorted(painting(spark, str(tmp_path / "parts")).collect()) == sorted(folded_strokes(log).collect())
    finally:
        running.stop()


def test_leave_one_out_trains_on_the_other_maps(spark):
    """Each map is scored by what the others teach: swapped labels on one map show up."""
    from cellscape.functions.constants import BASE_FEATURES
    from cellscape.operators import evaluate, grid

    px = spark.range(3 * 64).select(
        F.floor(F.col("id") / 64).alias("map_no"), F.floor(F.col("id") % 64 / 8).alias("r"), (F.col("id") % 8).alias("c"),
        F.lit(8).cast("bigint").alias("height"), F.lit(8).cast("bigint").alias("width"))
    px = px.withColumns({n: (F.col("c") % 2).cast("double") for n in BASE_FEATURES})
    cells = grid.with_cells(px, 8).select("map_no", "ci", "cj", (1 + F.col("cj") % 2).cast("int").alias("right")).withColumn(
        "code", F.when(F.col("map_no") < 2, F.col("right")).otherwise(3 - F.col("right")))
    samples = grid.with_cells(px, 8).join(cells.select("map_no", "ci", "cj", F.col("code").alias("label")), ["map_no", "ci", "cj"]).withColumn("w", F.lit(1.0))
    plan = spark.createDataFrame([(0, None), (2, None), (1, "left out")], "map_no bigint, reason string")
    got = {r["map_no"]: r for r in evaluate.leave_one_out(px, samples.where("map_no <> 0 or label > 0"), plan, model.forest(num_trees=5, max_depth=2), BASE_FEATURES, cells, 8).collect()}
    assert set(got) == {0, 2}
    assert got[2]["m12"] + got[2]["m21"] == 64           # the first two maps agree against the third
