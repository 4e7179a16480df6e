"""Queries over models, evaluation and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.functions import raster as R
from cellscape.functions.constants import BASE_FEATURES
from cellscape.operators import evaluate, grid, labels, model, sampling, training
from cellscape.plans.pixels import SCORED, scored_cells
from cellscape.plans.registry import query
from cellscape.plans.views import GRID, PX, Views, text_id
from cellscape.session import cut_lineage, scratch_path
from cellscape.sources import catalog as catalog_files
from cellscape.sources import raster as raster_files
from cellscape.sources import sinks

SIX = list(BASE_FEATURES)

# -- metrics ---------------------------------------------------------------------

MATRIX = "matrix AS (SELECT map_no, " + ", ".join(
    f"count(*) FILTER (WHERE truth={a} AND pred={b}) AS m{a}{b}" for a, b in evaluate.CONFUSION
) + ", count(*) FILTER (WHERE truth IN (1,2,3) AND coalesce(pred NOT IN (1,2,3), true)) AS violations FROM scored GROUP BY 1)"


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN violations>0 THEN NULL WHEN {den}>0 THEN CAST({num} AS DOUBLE)/({den}) ELSE 0 END"


def _parts(k: int) -> tuple[str, str, str]:
    return f"m{k}{k}", "(" + "+".join(f"m{k}{p}" for p in (1, 2, 3)) + ")", "(" + "+".join(f"m{t}{k}" for t in (1, 2, 3)) + ")"


def class_sql(source: str, key: str) -> str:
    out = []
    for k in (1, 2, 3):
        tp, sup, pre = _parts(k)
        out.append(f"""SELECT {key} {k} AS class, {_ratio(tp, pre)} AS precision, {_ratio(tp, sup)} AS recall, {_ratio(f'2*{tp}', f'{sup}+{pre}')} AS f1,
            {_ratio(tp, f'{sup}+{pre}-{tp}')} AS iou, {sup} AS support FROM {source}""")
    return " UNION ALL ".join(out)


def overall_sql(source: str, key: str) -> str:
    n = "(" + "+".join(f"m{a}{b}" for a, b in evaluate.CONFUSION) + ")"
    f1 = [_ratio(f"2*{_parts(k)[0]}", f"{_parts(k)[1]}+{_parts(k)[2]}") for k in (1, 2, 3)]
    return f"SELECT {key} {n} AS n, {_ratio('(m11+m22+m33)', n)} AS accuracy, ({f1[0]}+{f1[1]}+{f1[2]})/3 AS macro_f1 FROM {source}"


POOL = "SELECT " + ", ".join(f"CAST(sum(m{a}{b}) AS BIGINT) AS m{a}{b}" for a, b in evaluate.CONFUSION) + ", CAST(sum(violations) AS BIGINT) AS violations FROM "


def matrix(v: Views):
    return evaluate.confusion(scored_cells(v), ["map_no"])


@query("E6_confusion", f"WITH {SCORED}, {MATRIX} " + " UNION ALL ".join(f"SELECT map_no, {a} AS truth, {b} AS pred, m{a}{b} AS n FROM matrix" for a, b in evaluate.CONFUSION), "paint px_cell")
def confusion(v: Views):
    return evaluate.confusion_rows(matrix(v), ["map_no"])


@query("E6_missing_predictions", f"WITH {SCORED}, {MATRIX} SELECT map_no, violations FROM matrix", "paint px_cell")
def missing_predictions(v: Views):
    return matrix(v).select("map_no", "violations")


@query("E6_vector_confusion", """
    WITH s AS (SELECT CASE WHEN vec_id%11=0 THEN NULL ELSE 1+label%3 END AS truth, 1+(list_position(embedding, list_max(embedding))-1)%3 AS pred FROM embeddings)
    SELECT t.v AS truth, p.v AS pred, count(s.truth) AS n FROM (VALUES (1),(2),(3)) t(v) CROSS JOIN (VALUES (1),(2),(3)) p(v) LEFT JOIN s ON s.truth=t.v AND s.pred=p.v GROUP BY 1,2""")
def vector_confusion(v: Views):
    e = v.table("embeddings")
    scored = e.select(F.when(F.col("vec_id") % 11 != 0, 1 + F.col("label") % 3).alias("truth"),
                      (1 + (F.array_position("embedding", F.array_max("embedding")) - 1) % 3).alias("pred"))
    return evaluate.confusion_rows(evaluate.confusion(scored, []), [])


@query("E7_class_metrics", f"WITH {SCORED}, {MATRIX} {class_sql('matrix', 'map_no,')}", "paint px_cell")
def class_metrics(v: Views):
    return evaluate.class_metrics(matrix(v), ["map_no"])


@query("E7_overall_metrics", f"WITH {SCORED}, {MATRIX} {overall_sql('matrix', 'map_no,')}", "paint px_cell")
def overall_metrics(v: Views):
    return evaluate.overall_metrics(matrix(v), ["map_no"])


@query("E8_pooled_summary", f"WITH {SCORED}, {MATRIX}, pool AS ({POOL} matrix) SELECT n, accuracy, macro_f1, CAST(round((SELECT CASE WHEN count(macro_f1)=count(*) THEN avg(macro_f1) END FROM ({overall_sql('matrix', 'map_no,')}))*1e9) AS BIGINT) AS map_mean_e9 FROM ({overall_sql('pool', '')})", "paint px_cell")
def pooled_summary(v: Views):
    return evaluate.fold_summary(matrix(v)).select("n", "accuracy", "macro_f1", F.round(F.col("map_mean_macro_f1") * 1e9).cast("bigint").alias("map_mean_e9"))


BASELINE = """base AS (SELECT map_no, truth, 1 AS pred FROM scored), bmatrix AS (SELECT map_no, """ + ", ".join(
    f"count(*) FILTER (WHERE truth={a} AND pred={b}) AS m{a}{b}" for a, b in evaluate.CONFUSION) + ", 0 AS violations FROM base GROUP BY 1)"


@query("E11_result_views", f"""
    WITH {SCORED}, {MATRIX}, {BASELINE}, pool AS ({POOL} matrix), bpool AS ({POOL} bmatrix)
    {overall_sql('pool', "'all' AS scope,")} UNION ALL {overall_sql('bpool', "'baseline' AS scope,")} UNION ALL {overall_sql('matrix', "'map '||map_no AS scope,")}""", "paint px_cell")
def result_views(v: Views):
    baseline = evaluate.confusion(scored_cells(v).withColumn("pred", F.lit(1)), ["map_no"])
    return evaluate.result_views(matrix(v), baseline)


# -- catalog, folds, eligibility -----------------------------------------------------

CATALOG = """ecat AS (SELECT k.map_no, section, coalesce(site, CAST(k.map_no AS VARCHAR)) AS site, coalesce(grp, site, CAST(k.map_no AS VARCHAR)) AS grp, snapshot, painted_cells, sure_cells,
      coalesce(w.verified,false) AS verified, coalesce(w.restricted,false) AS restricted, label_status, sure_cells>0 AS available, CASE WHEN sure_cells=0 THEN 'no sure manual cells' END AS reason
    FROM (SELECT map_no, count(*) FILTER (WHERE code>0) AS painted_cells, count(*) FILTER (WHERE code>0 AND conf=1 AND NOT accepted AND map_no%4<>2) AS sure_cells, 'draft' AS snapshot FROM paint GROUP BY 1) k
    JOIN (SELECT map_no, 'sec'||map_no%3 AS section, CASE WHEN map_no%2=0 THEN 'site'||map_no//4 END AS site, CASE WHEN map_no%5=0 THEN 'g'||map_no//2 END AS grp FROM shape) m USING (map_no)
    LEFT JOIN (SELECT map_no, max(CASE WHEN key='verified' THEN value='true' END) AS verified, max(CASE WHEN key='restricted' THEN value='true' END) AS restricted,
                      max(CASE WHEN key='label_status' THEN value END) AS label_status FROM merged GROUP BY 1) w USING (map_no) WHERE painted_cells>0)"""


def evaluation_catalog_of(v: Views):
    m = F.col("map_no")
    maps = v.maps.select(
        "map_no", text_id("sec", m % 3).alias("section"), F.when(m % 2 == 0, text_id("site", R.int_div(m, 4))).alias("site"),
        F.when(m % 5 == 0, text_id("g", R.int_div(m, 2))).alias("grp"))
    unsure = v.paint.withColumns({"source": F.lit("draft"), "conf": F.when(m % 4 == 2, F.greatest(F.col("conf"), F.lit(2))).otherwise(F.col("conf"))})
    return evaluate.evaluation_catalog(maps, unsure, labels.merged_metadata(v.meta))


@query("E1_evaluation_catalog", f"WITH {CATALOG} SELECT * FROM ecat", "paint shape merged")
def evaluation_catalog(v: Views):
    return evaluation_catalog_of(v)


MEMORY = """mem AS (SELECT map_no, map_no IN (SELECT map_no FROM merged WHERE key='verified' AND value='true') AS verified, count(*) AS rows,
      count(*) FILTER (WHERE label=1) AS n1, count(*) FILTER (WHERE label=2) AS n2, count(*) FILTER (WHERE label=3) AS n3 FROM teach WHERE w>0 GROUP BY 1)"""
PLAN = f"""{MEMORY}, sel AS (SELECT DISTINCT user_id//16+CASE WHEN event_id%50=0 THEN 1000 ELSE 0 END AS map_no FROM events),
    plan AS (SELECT s.map_no, coalesce(c.grp, CAST(s.map_no AS VARCHAR)) AS grp, CASE WHEN coalesce(m.verified,false) THEN 'leave-one-map-out' ELSE 'painted-holdout' END AS mode,
      (SELECT count(*) FILTER (WHERE verified) FROM mem)-CASE WHEN coalesce(m.verified,false) THEN 1 ELSE 0 END AS train_maps,
      (SELECT count(*) FILTER (WHERE NOT verified) FROM mem)+CASE WHEN coalesce(m.verified,false) THEN 1 ELSE 0 END AS excluded_maps,
      CAST(coalesce((SELECT sum(rows) FROM mem WHERE verified),0)-CASE WHEN coalesce(m.verified,false) THEN m.rows ELSE 0 END AS BIGINT) AS train_rows,
      CASE WHEN NOT coalesce(c.available,false) THEN coalesce(c.reason,'no painted labels')
           WHEN coalesce((SELECT sum(rows) FROM mem WHERE verified),0)-CASE WHEN coalesce(m.verified,false) THEN m.rows ELSE 0 END=0 THEN 'no verified training samples remain' END AS reason
      FROM sel s LEFT JOIN ecat c USING (map_no) LEFT JOIN mem m USING (map_no))"""


def memory_of(v: Views):
    """Sample memory with each map's verification and row count."""
    good = labels.merged_metadata(v.meta).where("key = 'verified' and value = 'true'").select("map_no", F.lit(True).alias("verified"))
    return v.teach.where("w > 0").groupBy("map_no").agg(F.count(F.lit(1)).alias("rows")).join(good, "map_no", "left").fillna(False, ["verified"])


def plan_of(v: Views):
    e = v.table("events")
    selected = e.select((R.int_div(F.col("user_id"), 16) + F.when(F.col("event_id") % 50 == 0, 1000).otherwise(0)).alias("map_no"))
    return evaluate.fold_plan(selected, evaluation_catalog_of(v), memory_of(v))


@query("E2_fold_plan", f"WITH {CATALOG}, {PLAN} SELECT * FROM plan", "paint shape merged teach")
def fold_plan(v: Views):
    return plan_of(v)


@query("E2_fold_members", f"WITH {CATALOG}, {PLAN} SELECT p.map_no AS fold, m.map_no AS train_map FROM plan p JOIN mem m ON m.verified AND m.map_no<>p.map_no WHERE p.reason IS NULL", "paint shape merged teach")
def fold_members(v: Views):
    return evaluate.fold_members(plan_of(v), memory_of(v))


ELIGIBLE = """cover AS (SELECT map_no, ci, cj, count(*) AS area, count(z) AS ground, count(*) FILTER (WHERE fin) AS finite, count(*) FILTER (WHERE fin AND label IS NOT NULL) AS known
      FROM (SELECT l.map_no, ci, cj, l.z, label, l.z IS NOT NULL AND rough IS NOT NULL AS fin FROM labelled l JOIN feature USING (map_no, r, c)) GROUP BY 1,2,3),
    elig AS (SELECT s.map_no, s.ci, s.cj, coalesce(area,0) AS area, coalesce(ground,0) AS ground, coalesce(finite,0) AS finite, coalesce(known,0) AS known, coalesce(code,0) AS code,
      coalesce(code IN (1,2,3) AND conf=1 AND NOT accepted,false) AS manual,
      coalesce(code IN (1,2,3) AND conf=1 AND NOT accepted,false) AND coalesce(area>0 AND ground>0 AND 10*ground>=9*area AND 10*finite>=9*ground AND 10*known>=9*ground,false) AS eligible
      FROM spine s LEFT JOIN cover USING (map_no, ci, cj) LEFT JOIN paint USING (map_no, ci, cj))"""


def eligible_of(v: Views):
    px = grid.cells_to_labels(v.feature, v.paint, GRID)
    return evaluate.eligible_cells(px, v.paint, grid.cell_spine(v.maps, GRID), GRID, SIX)


@query("E3_eligible_cells", f"WITH {ELIGIBLE} SELECT * FROM elig", "labelled feature spine paint")
def eligible_cells(v: Views):
    return eligible_of(v)


@query("E4_exclusion_counters", f"""WITH {ELIGIBLE} SELECT map_no, count(*) FILTER (WHERE area=0) AS no_pixel_cells, count(*) FILTER (WHERE NOT manual) AS not_sure_manual_cells,
    count(*) FILTER (WHERE manual AND NOT eligible) AS insufficient_coverage, count(*) FILTER (WHERE eligible) AS eligible_cells,
    coalesce(CAST(sum(finite) AS DOUBLE)/nullif(sum(ground),0),0) AS coverage_fraction FROM elig GROUP BY 1""", "labelled feature spine paint")
def exclusion_counters(v: Views):
    return evaluate.exclusion_counts(eligible_of(v))


@query("E5_majority_baseline", f"""WITH {CATALOG}, {PLAN}, tot AS (SELECT sum(n1) AS t1, sum(n2) AS t2, sum(n3) AS t3 FROM mem WHERE verified),
    left_ AS (SELECT p.map_no, CAST(t1-CASE WHEN m.verified THEN m.n1 ELSE 0 END AS BIGINT) AS n1, CAST(t2-CASE WHEN m.verified THEN m.n2 ELSE 0 END AS BIGINT) AS n2, CAST(t3-CASE WHEN m.verified THEN m.n3 ELSE 0 END AS BIGINT) AS n3
      FROM plan p CROSS JOIN tot LEFT JOIN mem m USING (map_no))
    SELECT *, CASE WHEN greatest(n1,n2,n3)=0 THEN NULL WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS majority FROM left_""", "paint shape merged teach")
def majority_baseline(v: Views):
    flags = memory_of(v).select("map_no", "verified")
    return evaluate.majority_baseline(v.teach.join(flags, "map_no"), plan_of(v))


@query("E10_report_flags", f"""WITH {CATALOG}, {PLAN} SELECT 'skipped' AS kind, map_no, reason AS text FROM plan WHERE reason IS NOT NULL
    UNION ALL SELECT 'restricted', NULL, CAST((SELECT bool_or(restricted) FROM ecat) OR (SELECT count(*)>0 FROM mem WHERE map_no NOT IN (SELECT map_no FROM ecat)) AS VARCHAR)""", "paint shape merged teach")
def report_flags(v: Views):
    cat = evaluation_catalog_of(v)
    samples = memory_of(v).select("map_no").join(cat.select("map_no", "restricted"), "map_no", "left")
    plan = plan_of(v).where("reason is not null").select("map_no", "reason")
    flag, skipped = evaluate.report_flags(samples, cat, [plan])
    return skipped.select(F.lit("skipped").alias("kind"), "map_no", F.col("reason").alias("text")).unionByName(
        flag.select(F.lit("restricted").alias("kind"), F.lit(None).cast("bigint").alias("map_no"), F.col("restricted").cast("string").alias("text")))


# -- models ------------------------------------------------------------------------

SMALL_FOREST = dict(num_trees=10, max_depth=8)


def training_sample(v: Views, per_stratum: int = 300):
    return sampling.stratified(v.teach, per_stratum).select("map_no", "r", "c", "label", "w", *SIX)


CLEAR_COUNTS = "SELECT map_no, CASE WHEN z IS NOT NULL AND rough IS NOT NULL THEN truth END AS prediction, count(*) AS n FROM clear GROUP BY 1, 2"


def clear_sample(v: Views, per_stratum: int = 300):
    """A sample on which the units are plain, so that SQL can say what a model must predict."""
    rows = training.training_pixels(v.clear, v.paint, GRID)
    return sampling.stratified(rows, per_stratum).select("map_no", "r", "c", "label", "w", *SIX)


def counted(scored):
    return scored.groupBy("map_no", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("M1_forest", CLEAR_COUNTS, "clear")
def forest(v: Views):
    fitted = model.fit(clear_sample(v), model.forest(**SMALL_FOREST))
    return counted(model.predict(fitted, v.clear))


@query("M2_boosting", CLEAR_COUNTS, "clear")
def boosting(v: Views):
    fitted = model.fit(clear_sample(v, 60), model.boosting(rounds=3, max_depth=3))
    return counted(model.predict(fitted, v.clear))


@query("M3_predict_coverage", """
    SELECT map_no, count(*) AS pixels, count(*) FILTER (WHERE z IS NOT NULL AND rough IS NOT NULL) AS predicted, 0 AS outside FROM feature GROUP BY 1""", "feature")
def predict_coverage(v: Views):
    """Every pixel comes back; those with all features carry a known unit."""
    fitted = model.fit(training_sample(v, 50), model.forest(num_trees=3, max_depth=4))
    scored = model.predict(fitted, v.feature)
    return scored.groupBy("map_no").agg(F.count(F.lit(1)).alias("pixels"), F.count("prediction").alias("predicted"),
                                        F.count_if(~F.col("prediction").isin(1, 2, 3)).cast("int").alias("outside"))


@query("M4_confidence_range", """
    SELECT map_no, count(*) FILTER (WHERE z IS NOT NULL AND rough IS NOT NULL) AS confident, 0 AS out_of_range FROM feature GROUP BY 1""", "feature")
def confidence_range(v: Views):
    """Confidence lies between a toss-up and certainty wherever there is a prediction."""
    fitted = model.fit(training_sample(v, 50), model.forest(num_trees=3, max_depth=4))
    scored = model.predict(fitted, v.feature)
    bad = ~F.col("confidence").between(1 / 3 - 1e-9, 1 + 1e-9)
    return scored.groupBy("map_no").agg(F.count("confidence").alias("confident"), F.count_if(bad).cast("int").alias("out_of_range"))


@query("M5_retrain", CLEAR_COUNTS, "clear")
def retrain(v: Views):
    """Only verified paintings teach; all pixels are predicted."""
    fitted, _ = model.retrain(v.clear, v.paint, labels.merged_metadata(v.meta), model.forest(**SMALL_FOREST), GRID)
    return counted(model.predict(fitted, v.clear))


@query("M6_replace_samples", """
    SELECT map_no, count(*) AS rows FROM teach WHERE map_no<>2 OR z IS NOT NULL GROUP BY 1""", "teach")
def replace_samples(v: Views):
    held = v.maps.where("map_no = 1").select("map_no")
    memory = model.replaced_samples(v.teach, v.teach.where("z is not null"), 2, held)
    return memory.groupBy("map_no").agg(F.count(F.lit(1)).alias("rows"))


@query("M7_interactive_preview", """
    SELECT map_no, r, c, CASE WHEN z IS NOT NULL AND rough IS NOT NULL THEN truth END AS prediction, CASE WHEN z IS NOT NULL AND rough IS NOT NULL THEN true END AS sure
    FROM clear WHERE r%4=0 AND c%4=0""", "clear")
def interactive_preview(v: Views):
    """Train on the painted cells' sample and predict every fourth pixel."""
    picked = sampling.per_cell(v.clear, v.paint, GRID, 30).withColumnRenamed("code", "label").withColumn("w", F.lit(1.0))
    fitted = model.fit(picked, model.forest(**SMALL_FOREST))
    return model.predict(fitted, grid.strided(v.clear, 4)).select("map_no", "r", "c", "prediction", (F.col("confidence") > 0.9).alias("sure"))


@query("M8_single_class", """
    SELECT map_no, r, c, CASE WHEN z IS NOT NULL AND rough IS NOT NULL THEN 2 END AS prediction, CASE WHEN z IS NOT NULL AND rough IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM feature""", "feature")
def single_class(v: Views):
    fitted = model.fit(training_sample(v).withColumn("label", F.lit(2)), model.forest())
    return model.predict(fitted, v.feature).select("map_no", "r", "c", "prediction", "confidence")


FOLD_TRUTH = f"""truth AS (SELECT e.map_no, e.code AS truth, CASE WHEN greatest(n1,n2,n3)=0 THEN NULL WHEN n1>=n2 AND n1>=n3 THEN 1 WHEN n2>=n3 THEN 2 ELSE 3 END AS majority
      FROM elig e JOIN plan p USING (map_no) JOIN (SELECT p.map_no, t1-CASE WHEN m.verified THEN m.n1 ELSE 0 END AS n1, t2-CASE WHEN m.verified THEN m.n2 ELSE 0 END AS n2,
        t3-CASE WHEN m.verified THEN m.n3 ELSE 0 END AS n3 FROM plan p CROSS JOIN (SELECT sum(n1) AS t1, sum(n2) AS t2, sum(n3) AS t3 FROM mem WHERE verified) LEFT JOIN mem m USING (map_no)) b USING (map_no)
      WHERE e.eligible AND p.reason IS NULL)"""


def _fold_matrix(name: str, pred: str) -> str:
    return MATRIX.replace("matrix AS", f"{name} AS").replace("FROM scored", f"FROM (SELECT map_no, truth, {pred} AS pred FROM truth)")


@query("E9_leave_one_out", f"""WITH {CATALOG}, {PLAN}, {ELIGIBLE}, {FOLD_TRUTH}, {_fold_matrix('mm', 'truth')}, {_fold_matrix('bm', 'majority')}
    SELECT kind, map_no, n, accuracy, macro_f1, NULL AS reason FROM ({overall_sql('mm', "'model' AS kind, map_no,")} UNION ALL {overall_sql('bm', "'baseline' AS kind, map_no,")})
    UNION ALL SELECT 'skipped', map_no, NULL, NULL, NULL, reason FROM plan WHERE reason IS NOT NULL""", "labelled feature spine paint shape merged teach")
def leave_one_out(v: Views):
    """Fit, predict, vote and score every usable fold, next to its baseline; skipped folds with their reasons."""
    eligible = eligible_of(v).where("eligible")      # `clear` has the holes of `feature`
    flags = memory_of(v).select("map_no", "verified")
    samples = cut_lineage(clear_sample(v).join(flags.where("verified"), "map_no", "left_semi"))
    plan = cut_lineage(plan_of(v))
    baseline = evaluate.majority_baseline(v.teach.join(flags, "map_no"), plan)
    scores, skipped = evaluate.evaluation_run(v.clear, samples, plan, model.forest(num_trees=5, max_depth=5), BASE_FEATURES, eligible, baseline, GRID)
    return evaluate.overall_metrics(scores, ["kind", "map_no"]).withColumn("reason", F.lit(None).cast("string")).unionByName(
        skipped.withColumn("kind", F.lit("skipped")), allowMissingColumns=True)


# -- stored results: written by Spark from the tables and read back --------------------


@query("S1_catalog_scan", """
    SELECT manifest_folder, working_dem, section, site, grp FROM record""", "record")
def catalog_scan(v: Views):
    """Catalog files per site: whole-file lists, with broken and non-list files beside them."""
    path = scratch_path(v.spark, "catalogs")
    # A catalog file is one document: a new file every 5000 records keeps each one small.
    entries = v.record.withColumn("part", R.int_div(F.col("part_no"), 5000)).select(
        "manifest_folder", "part", F.to_json(F.struct("working_dem", "section", "site", F.col("grp").alias("group"))).alias("entry"))
    parts = entries.groupBy("manifest_folder", "part").agg(F.collect_list("entry").alias("e"))
    whole = parts.select("manifest_folder", F.concat(F.lit("["), F.array_join("e", ",\n"), F.lit("]")).alias("value"), F.concat(F.lit("p"), "part").alias("file"))
    broken = v.record.select("manifest_folder").distinct().select(
        "manifest_folder", F.explode(F.array(
            F.struct(F.lit("[{\"working_dem\": ").alias("value"), F.lit("broken").alias("file")),
            F.struct(F.lit("{\"working_dem\": \"x.tif\"}").alias("value"), F.lit("object").alias("file")),
            F.struct(F.lit("[{\"site\": \"no dem\"}, {\"working_dem\": 5}]").alias("value"), F.lit("nodem").alias("file"))))
        .alias("f")).select("manifest_folder", "f.value", "f.file")
    whole.unionByName(broken).repartition("manifest_folder", "file").write.partitionBy("manifest_folder", "file").text(path)
    plain = path.removeprefix("file:")
    found = catalog_files.records(catalog_files.manifest_listing(v.spark, plain, "part-*"))
    return found.select(F.regexp_extract("manifest_folder", "manifest_folder=([^/]*)", 1).alias("manifest_folder"), "working_dem", "section", "site", "grp")


@query("S14_latest_report", """
    SELECT strftime(max(d), '%Y%m%dT%H%M%S')||'.000000Z-'||lpad(CAST(max(k) AS VARCHAR),8,'0') AS run_id, max(k)+1 AS n FROM
      (SELECT o_orderdate AS d, o_orderkey AS k FROM orders WHERE o_orderkey%5=0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def latest_report(v: Views):
    k, n = F.col("o_orderkey"), F.col("o_orderkey") + 1
    run_id = F.concat(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit(".000000Z-"), F.lpad(k.cast("string"), 8, "0"))

    def document(run, aggregate, maps, names=F.array(F.lit("a"), F.lit("b")), folds=F.array(F.struct(F.lit("a").alias("map")))):
        return F.to_json(F.struct(run.alias("run_id"), F.struct(aggregate.alias("aggregate"), folds.alias("folds")).alias("validation"),
                                  names.alias("selected_maps"), F.struct(maps.alias("maps")).alias("provenance")))

    good = F.struct(n.alias("n"), F.lit(0.5).alias("accuracy"), F.lit(0.25).alias("macro_f1"))
    wild = F.struct(n.alias("n"), F.lit(1.5).alias("accuracy"), F.lit(0.25).alias("macro_f1"))
    some = F.struct(F.lit("a").alias("m"))
    text = (
        F.when(k % 5 == 0, document(run_id, good, some)).when(k % 10 == 1, document(run_id, good, some, names=F.array(F.lit(1))))
        .when(k % 5 == 1, F.lit('{"run_id": ')).when(k % 10 == 2, document(run_id, good, some, folds=F.array(F.lit("x"))))
        .when(k % 5 == 2, document(F.lit("other"), good, some)).when(k % 5 == 3, document(run_id, wild, some))
        .otherwise(document(run_id, good, F.array(F.lit(1)))))
    reports = v.table("orders").select(run_id.alias("run_id"), text.alias("value"))
    best = catalog_files.latest_report(reports)
    return best.select("run_id", F.get_json_object("report", "$.validation.aggregate.n").cast("bigint").alias("n"))


@query("S16_label_map_sink", "SELECT map_no, r, c, coalesce(label,255) AS value, 'site'||map_no%3 AS site FROM labelled", "labelled")
def label_map_sink(v: Views):
    path = scratch_path(v.spark, "labels")
    sinks.write_map(v.labelled.withColumn("site", text_id("site", F.col("map_no") % 3)), "label", path)
    return v.spark.read.parquet(path).select(F.col("map_no").cast("bigint").alias("map_no"), "r", "c", F.col("value").cast("int").alias("value"), "site")


@query("S16_palette", "SELECT * FROM (VALUES (0,150,150,150,255),(1,70,110,200,255),(2,190,215,60,255),(3,170,50,60,255)) p(code,red,green,blue,alpha) WHERE code IN (SELECT code FROM stroke)", "stroke")
def palette(v: Views):
    return sinks.palette(v.spark).join(v.stroke.select("code"), "code", "left_semi")


@query("S17_report_sink", f"WITH {SCORED}, {MATRIX}, pool AS ({POOL} matrix) SELECT 'run-1' AS run_id, n, accuracy, macro_f1 FROM ({overall_sql('pool', '')})", "paint px_cell")
def report_sink(v: Views):
    path = scratch_path(v.spark, "reports")
    metrics = evaluate.overall_metrics(evaluate.pooled(matrix(v)), [])
    sinks.write_report(metrics.select(F.lit("run-1").alias("run_id"), F.struct("n", "accuracy", "macro_f1").alias("aggregate")), path)
    return v.spark.read.schema("run_id string, aggregate struct<n:bigint,accuracy:double,macro_f1:double>").option("recursiveFileLookup", True).json(path).select("run_id", "aggregate.*")


@query("S18_model_artifact", CLEAR_COUNTS, "clear")
def model_artifact(v: Views):
    """Saved next to its schema, loaded behind the schema check, then used."""
    path = scratch_path(v.spark, "model")
    model.save(model.fit(clear_sample(v, 50), model.forest(num_trees=3, max_depth=4)), path)
    return counted(model.predict(model.load(path), v.clear))


@query("S19_painting_sink", """
    SELECT map_no, source, ci, cj, code, CASE WHEN bool_or(code>0 AND conf<>1) OVER w THEN conf END AS conf,
           CASE WHEN bool_or(accepted) OVER w THEN accepted END AS accepted FROM cells WINDOW w AS (PARTITION BY map_no, source)""", "cells")
def painting_sink(v: Views):
    path = scratch_path(v.spark, "paintings")
    sinks.write_paintings(v.cells, path)
    # Writing one source again replaces that source alone.
    sinks.write_paintings(v.cells.where("source = 'saved'"), path)
    back = v.spark.read.parquet(path)
    return back.select(F.col("map_no").cast("bigint").alias("map_no"), "source", "ci", "cj", "code", "conf", "accepted")


@query("S20_layer_sources", """
    SELECT 'm'||p_partkey AS map_id, CASE WHEN p_size%2=0 THEN 'sfs' ELSE 'nac' END AS layer, p_size AS width, CASE WHEN p_size%7=0 THEN 'nan' ELSE '-9999' END AS nodata, 2.0::DOUBLE AS scale FROM part""")
def layer_sources(v: Views):
    path = scratch_path(v.spark, "headers")
    size = F.col("p_size")
    grid_ = F.struct(size.alias("width"), size.alias("height"), F.array(F.lit(5.0), F.lit(0.0)).alias("transform"), F.lit("moon").alias("crs_wkt"), F.array(F.lit(5.0)).alias("spacing"))
    v.table("part").select(
        text_id("m", F.col("p_partkey")).alias("map_id"), F.when(size % 2 == 0, "sfs").otherwise("nac").alias("layer"), grid_.alias("grid"),
        F.lit("float32").alias("dtype"), F.when(size % 7 == 0, "nan").otherwise("-9999").alias("nodata"), F.array(F.lit(2.0)).alias("scales"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags")).write.json(path)
    return raster_files.layer_sources(v.spark, path).select("map_id", "layer", "grid.width", "nodata", F.col("scales")[0].alias("scale"))
