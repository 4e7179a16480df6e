"""Leave-one-out: what the driver holds does not add up over the folds."""

from cellscape.operators import evaluate, model

NAMES = ("slope",)


def test_folds_are_written_in_batches(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FOLDS_AT_ONCE", 2)
    px = spark.range(5 * 64).selectExpr(
        "id div 64 map_no", "id div 8 % 8 r", "id % 8 c", "8L height", "8L width", "CAST(1 + id % 3 AS INT) label", "1D w", "100D * (1 + id % 3) slope")
    plan = spark.sql("SELECT id map_no, CAST(NULL AS string) reason FROM range(5)")
    truth = px.selectExpr("map_no", "CAST(r AS INT) ci", "CAST(c AS INT) cj", "label code")
    made = evaluate.leave_one_out(px, px, plan, model.forest(num_trees=3, max_depth=3), NAMES, truth, 8)
    # Every fold is read from what was written, whatever their number: no fold's plan is left.
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {r["map_no"]: (r["m11"] + r["m22"] + r["m33"], r["violations"]) for r in made.collect()} == {k: (64, 0) for k in range(5)}


def test_folds_that_learn_from_the_same_rows_share_a_model(spark, monkeypatch):
    fits, fit = [], model.RandomForestClassifier.fit
    monkeypatch.setattr(model.RandomForestClassifier, "fit", lambda self, rows: fits.append(1) or fit(self, rows))
    px = spark.range(6 * 64).selectExpr(
        "id div 64 map_no", "id div 8 % 8 r", "id % 8 c", "8L height", "8L width", "CAST(1 + id % 3 AS INT) label", "1D w", "100D * (1 + id % 3) slope")
    plan = spark.sql("SELECT id map_no, CAST(NULL AS string) reason FROM range(6)")
    truth = px.selectExpr("map_no", "CAST(r AS INT) ci", "CAST(c AS INT) cj", "label code")
    made = evaluate.leave_one_out(px, px.where("map_no < 2"), plan, model.forest(num_trees=3, max_depth=3), NAMES, truth, 8)
    assert {r["map_no"]: (r["m11"] + r["m22"] + r["m33"], r["violations"]) for r in made.collect()} == {k: (64, 0) for k in range(6)}
    assert len(fits) == 3     # without map 0, without map 1, and one for the four maps that teach nothing
