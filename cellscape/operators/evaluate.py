"""Fold plans, eligibility, confusion and metrics.

Scores live in long tables keyed by `scope` (a map, the pool or a baseline): nine counts
per scope carry everything, so no metric needs a second look at cells or pixels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import CODES, MIN_COVERAGE
from cellscape.operators.grid import CELL, cell_majority, code_counts, most_common, with_cells
from cellscape.operators.labels import sure_manual
from cellscape.session import drop_stored, scratch_path, stored

FITS_AT_ONCE = 8      # fits of leave-one-out that run side by side
FOLDS_AT_ONCE = 16    # folds that are scored together; the driver holds the models and plans of twice as many
CONFUSION = [(t, p) for t in CODES for p in CODES]
PLACE = ("map_no", "r", "c", "height", "width")


def evaluation_catalog(maps: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Painted maps with verification and the reason why one cannot be scored.

    maps: map_no, section, site, grp.  cells: effective paintings with source.
    meta: merged metadata.
    """
    paint = cells.groupBy("map_no").agg(
        F.count_if(F.col("code") > 0).alias("painted_cells"),
        F.count_if(sure_manual()).alias("sure_cells"),
        F.min("source").alias("snapshot"),
    ).where("painted_cells > 0")
    wide = meta.groupBy("map_no").agg(
        F.max(F.when(F.col("key") == "verified", F.col("value") == "true")).alias("verified"),
        F.max(F.when(F.col("key") == "restricted", F.col("value") == "true")).alias("restricted"),
        F.max(F.when(F.col("key") == "label_status", F.col("value"))).alias("label_status"),
    )
    reason = F.when(F.col("sure_cells") == 0, "no sure manual cells")
    return paint.join(maps, "map_no").join(wide, "map_no", "left").select(
        "map_no", "section", F.coalesce("site", F.col("map_no").cast("string")).alias("site"),
        F.coalesce("grp", "site", F.col("map_no").cast("string")).alias("grp"), "snapshot",
        "painted_cells", "sure_cells",
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce("restricted", F.lit(False)).alias("restricted"),
        "label_status", reason.isNull().alias("available"), reason.alias("reason"),
    )


def fold_plan(selected: DataFrame, catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """One fold per selected map, trained on every verified sample but its own.

    samples: map_no, verified, rows (usable training rows).  The training set of a fold
    is "all verified but one", so a fold needs two numbers and its own row, not a list
    of all other maps; `fold_members` spells the lists out where they are wanted.
    """
    usable = F.when(F.col("verified"), F.col("rows")).otherwise(0)
    memory = samples.agg(F.struct(
        F.coalesce(F.sum(usable), F.lit(0)).alias("rows"), F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("maps")
    )).scalar()
    own = samples.select("map_no", F.col("verified").alias("_v"), usable.alias("_rows"))
    info = catalog.select("map_no", "grp", "available", "reason")
    joined = selected.select("map_no").distinct().join(info, "map_no", "left").join(own, "map_no", "left").withColumn("_m", memory)
    total, n_verified, n_all = F.col("_m.rows"), F.col("_m.verified"), F.col("_m.maps")
    trained = F.coalesce("_v", F.lit(False))
    reason = (
        F.when(~F.coalesce("available", F.lit(False)), F.coalesce("reason", F.lit("no painted labels")))
        .when(total - F.coalesce("_rows", F.lit(0)) == 0, F.lit("no verified training samples remain"))
    )
    n_train = n_verified - trained.cast("int")
    return joined.select(
        "map_no", F.coalesce("grp", F.col("map_no").cast("string")).alias("grp"),
        F.when(trained, "leave-one-map-out").otherwise("painted-holdout").alias("mode"),
        n_train.cast("bigint").alias("train_maps"),
        (n_all - n_train).cast("bigint").alias("excluded_maps"),
        (total - F.coalesce("_rows", F.lit(0))).cast("bigint").alias("train_rows"),
        reason.alias("reason"),
    )


def selected_folds(plan: DataFrame) -> list:
    """Ids of the usable folds: as many as were asked for, each of which costs a model."""
    return sorted(row["map_no"] for row in plan.where("reason is null").select("map_no").collect())


def fold_members(plan: DataFrame, samples: DataFrame) -> DataFrame:
    """The training maps of each usable fold, one row per (fold, training map)."""
    folds = F.array(*[F.lit(f) for f in selected_folds(plan)])
    return samples.where("verified").select(
        F.explode(F.array_except(folds, F.array("map_no"))).alias("fold"), F.col("map_no").alias("train_map")
    )


def eligible_cells(px: DataFrame, cells: DataFrame, spine: DataFrame, grid: int, features: list[str],
                   minimum: float = MIN_COVERAGE) -> DataFrame:
    """Per cell the coverage counts and whether it may be scored.

    px: z, label (expanded painting) and the features.  Terrain coverage is judged on z,
    finite coverage on all features (they may reach less far), label coverage on both.
    """
    finite = F.col("z").isNotNull()
    for name in features:
        finite = finite & F.col(name).isNotNull()
    n = with_cells(px, grid).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("area"), F.count("z").alias("ground"), F.count_if(finite).alias("finite"),
        F.count_if(finite & F.col("label").isNotNull()).alias("known"),
    )
    paint = cells.select(*CELL, "code", sure_manual().alias("manual"))
    full = spine.join(n, list(CELL), "left").join(paint, list(CELL), "left").fillna(
        {"area": 0, "ground": 0, "finite": 0, "known": 0, "code": 0, "manual": False}
    )
    enough = (
        (F.col("area") > 0) & (F.col("ground") > 0)
        & (F.col("ground") >= F.lit(minimum) * F.col("area"))
        & (F.col("finite") >= F.lit(minimum) * F.col("ground"))
        & (F.col("known") >= F.lit(minimum) * F.col("ground"))
    )
    return full.withColumn("eligible", F.col("manual") & enough)


def exclusion_counts(eligible: DataFrame) -> DataFrame:
    """Why cells drop out, and how much of the terrain has features."""
    return eligible.groupBy("map_no").agg(
        F.count_if(F.col("area") == 0).alias("no_pixel_cells"),
        F.count_if(~F.col("manual")).alias("not_sure_manual_cells"),
        F.count_if(F.col("manual") & ~F.col("eligible")).alias("insufficient_coverage"),
        F.count_if("eligible").alias("eligible_cells"),
        F.coalesce(F.sum("finite").cast("double") / F.nullif(F.sum("ground"), F.lit(0)), F.lit(0.0)).alias("coverage_fraction"),
    )


def majority_baseline(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """E5: the most common unit of each fold's training rows, ties to the lowest code.

    Fold counts are the pooled counts minus the left-out map's own, so every row is
    counted once whatever the number of folds.
    """
    usable = samples.where("label in (1, 2, 3) and w > 0 and verified")
    per_map = usable.groupBy("map_no").agg(*code_counts("label"))
    pooled = per_map.agg(F.struct(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in CODES])).scalar()
    folds = plan.select("map_no").join(per_map, "map_no", "left").fillna(0, [f"n{k}" for k in CODES])
    left = folds.withColumn("_all", pooled).select(
        "map_no", *[(F.col(f"_all.n{k}") - F.col(f"n{k}")).alias(f"n{k}") for k in CODES]
    )
    return left.withColumn("majority", most_common("n", None))


def confusion(scored: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts per (truth, prediction), all nine present, as columns m11..m33, and the
    number of known truths that have no valid prediction (an error)."""
    t, p = F.col(truth), F.col(pred)
    return scored.where(t.isin(*CODES)).groupBy(*keys).agg(
        *[F.count_if((t == a) & F.coalesce(p == b, F.lit(False))).alias(f"m{a}{b}") for a, b in CONFUSION],
        F.count_if(~F.coalesce(p.isin(*CODES), F.lit(False))).alias("violations"),
    )


def confusion_rows(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The nine counts as rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred"), F.col(f"m{a}{b}").alias("n")) for a, b in CONFUSION])
    return matrix.select(*keys, F.inline(cells))


def _sound(matrix: DataFrame, value: Column) -> Column:
    """NULL where known truths lack a prediction: such a scope has no metrics."""
    return F.when(F.col("violations") == 0, value) if "violations" in matrix.columns else value


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def class_metrics(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1, IoU and support per class; zero where undefined."""
    out = []
    for k in CODES:
        tp = F.col(f"m{k}{k}")
        support = sum((F.col(f"m{k}{p}") for p in CODES[1:]), F.col(f"m{k}{CODES[0]}"))
        predicted = sum((F.col(f"m{t}{k}") for t in CODES[1:]), F.col(f"m{CODES[0]}{k}"))
        out.append(F.struct(
            F.lit(k).alias("class"), *[_sound(matrix, _ratio(a, b)).alias(name) for name, a, b in (
                ("precision", tp, predicted), ("recall", tp, support), ("f1", tp * 2, support + predicted), ("iou", tp, support + predicted - tp))],
            support.alias("support"),
        ))
    return matrix.select(*keys, F.inline(F.array(*out)))


def overall_metrics(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """N, accuracy and macro F1 per scope."""
    n = sum((F.col(f"m{t}{p}") for t, p in CONFUSION[1:]), F.col("m11"))
    hits = F.col("m11") + F.col("m22") + F.col("m33")
    f1 = []
    for k in CODES:
        support = sum((F.col(f"m{k}{p}") for p in CODES[1:]), F.col(f"m{k}{CODES[0]}"))
        predicted = sum((F.col(f"m{t}{k}") for t in CODES[1:]), F.col(f"m{CODES[0]}{k}"))
        f1.append(_ratio(F.col(f"m{k}{k}") * 2, support + predicted))
    return matrix.select(*keys, n.alias("n"), _sound(matrix, _ratio(hits, n)).alias("accuracy"),
                         _sound(matrix, (f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"))


def pooled(matrix: DataFrame) -> DataFrame:
    """The sum of the fold matrices."""
    return matrix.agg(*[F.sum(m).alias(m) for m in _counted(matrix)])


def _counted(matrix: DataFrame) -> list[str]:
    """The columns of a matrix that add up over scopes."""
    return [f"m{a}{b}" for a, b in CONFUSION] + (["violations"] if "violations" in matrix.columns else [])


def fold_summary(matrix: DataFrame, key: str = "map_no") -> DataFrame:
    """Pooled metrics next to the mean of the folds' own macro F1, in one pass."""
    counts = _counted(matrix)
    own = overall_metrics(matrix, [key, *counts])
    mean = F.when(F.count("macro_f1") == F.count(F.lit(1)), F.avg("macro_f1"))
    both = own.agg(*[F.sum(m).alias(m) for m in counts], mean.alias("map_mean_macro_f1"))
    return overall_metrics(both, ["map_mean_macro_f1"])


def result_views(model: DataFrame, baseline: DataFrame, key: str = "map_no") -> DataFrame:
    """Overall rows for every scope: pooled model, pooled baseline, each map."""
    def named(df: DataFrame, scope: Column) -> DataFrame:
        return df.select(scope.alias("scope"), "n", "accuracy", "macro_f1")

    return (
        named(overall_metrics(pooled(model), []), F.lit("all"))
        .unionByName(named(overall_metrics(pooled(baseline), []), F.lit("baseline")))
        .unionByName(named(overall_metrics(model, [key]), F.concat(F.lit("map "), F.col(key).cast("string"))))
    )


def leave_one_out(features: DataFrame, samples: DataFrame, plan: DataFrame, estimator, names, truth: DataFrame,
                  grid: int, parallelism: int = FITS_AT_ONCE) -> DataFrame:
    """Fit, predict, vote per cell and score for each fold: (map_no, m11..m33).

    truth: eligible cells with their code.  No fitted fold at all is an error.
    """
    made, _ = _fold_matrices(features, samples, plan, estimator, names, truth, grid, parallelism)
    if made is None:
        raise ValueError("no fold could be fitted")
    return made


def evaluation_run(features: DataFrame, samples: DataFrame, plan: DataFrame, estimator, names, truth: DataFrame,
                   baseline: DataFrame, grid: int, parallelism: int = FITS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """E9 with its report: (scores, skipped).

    scores: map_no, kind (`model` or `baseline`) and the nine counts of every fitted fold, the
    baseline being the most common unit of the fold's training rows (baseline: map_no,
    majority).  skipped: map_no, reason, for folds the plan rules out and for those whose
    training rows fit no model.
    """
    made, unfitted = _fold_matrices(features, samples, plan, estimator, names, truth, grid, parallelism)
    spark = features.sparkSession
    key = plan.schema["map_no"].dataType.simpleString()
    skipped = plan.where("reason is not null").select("map_no", "reason").unionByName(
        spark.createDataFrame([(m, "no usable training rows") for m in unfitted], f"map_no {key}, reason string"))
    guessed = truth.join(plan.where("reason is null").select("map_no"), "map_no", "left_semi").join(
        skipped.select("map_no"), "map_no", "left_anti").join(baseline.select("map_no", "majority"), "map_no")
    plainly = confusion(guessed.select(*CELL, F.col("code").alias("truth"), F.col("majority").alias("pred")), ["map_no"])
    scores = plainly.withColumn("kind", F.lit("baseline"))
    if made is not None:
        scores = made.withColumn("kind", F.lit("model")).unionByName(scores)
    return scores, skipped


def _fold_matrices(features, samples, plan, estimator, names, truth, grid, parallelism) -> tuple[DataFrame | None, list]:
    """The confusion counts of all folds that fit, and the folds that do not.

    Folds whose own map gives no training rows learn from the same rows, so one model serves them
    all.  Every other fold is one distributed fit, `parallelism` of them at a time, on the stored
    rows but its own.  Models score the pixels of the cells with a truth, which lie in the order of
    their maps; a batch of folds is voted and counted in one aggregate each and written while the
    next batch is fitted: models, plans and what the driver keeps of them do not add up over the folds.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import StorageLevel, inheritable_thread_target

    from cellscape.operators.model import fit_vectors, predict, usable_vectors

    spark = features.sparkSession
    folds = selected_folds(plan)
    if not folds:
        return None, []
    usable = plan.where("reason is null").select("map_no")
    by_map = lambda df: df.hint("rebalance", "map_no").sortWithinPartitions("map_no")
    known = stored(by_map(truth.select(*CELL, F.col("code").alias("truth")).join(usable, "map_no", "left_semi")), "truth")
    told = with_cells(features.select(*PLACE, *names), grid).join(known, list(CELL), "left_semi")
    pixels = stored(by_map(told.drop("ci", "cj")), "pixels")
    written = stored(usable_vectors(samples.where("map_no is not null"), names, "map_no").hint("rebalance"), "samples")
    rows = written.persist(StorageLevel.MEMORY_AND_DISK)     # each fit passes over them several times
    own: dict = {}
    for r in rows.groupBy("map_no", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        own.setdefault(r["map_no"], {})[r["label"]] = r["n"]
    total = {k: n for k in CODES if (n := sum(counts.get(k, 0) for counts in own.values()))}
    alone = [f for f in folds if f in own]
    alike = [f for f in folds if f not in own]
    path = scratch_path(spark, "folds")

    @inheritable_thread_target(spark)
    def without(fold):
        left = {k: n for k in total if (n := total[k] - own[fold].get(k, 0))}
        return fit_vectors(rows.where(F.col("map_no") != fold), left, estimator.copy(), names)

    def write(part: int, scored: list[DataFrame], cells: DataFrame) -> None:
        voting = reduce(DataFrame.unionByName, [df.where("prediction IS NOT NULL").select(*PLACE, "prediction") for df in scored])
        voted = cell_majority(voting, "prediction", grid=grid).select(*CELL, F.col("code").alias("pred"))
        made = confusion(cells.join(voted, list(CELL), "left"), ["map_no"])
        made.coalesce(1).write.parquet(f"{path}/part={part}")    # a row per fold
        schemas.append(made.schema)

    unfitted, schemas = [], []
    batches = [alone[at:at + FOLDS_AT_ONCE] for at in range(0, len(alone), FOLDS_AT_ONCE)]
    with ThreadPool(parallelism) as pool:
        ahead = pool.map_async(without, batches[0]) if batches else None
        if alike:
            model = fit_vectors(rows, total, estimator.copy(), names)
            if model.model is None and model.only is None:
                unfitted += alike
            else:
                ids = spark.createDataFrame([(f,) for f in alike], f"map_no {plan.schema['map_no'].dataType.simpleString()}")
                write(-1, [predict(model, pixels.join(ids, "map_no", "left_semi"))], known.join(ids, "map_no", "left_semi"))
        for at, some in enumerate(batches):
            models = dict(zip(some, ahead.get()))
            ahead = pool.map_async(without, batches[at + 1]) if at + 1 < len(batches) else None
            fitted = {f: m for f, m in models.items() if m.model is not None or m.only is not None}
            unfitted += [f for f in some if f not in fitted]
            if fitted:
                write(at, [predict(m, pixels.where(F.col("map_no") == f)) for f, m in fitted.items()], known.where(F.col("map_no").isin(*fitted)))
    rows.unpersist()
    drop_stored(pixels, known, written)
    return (spark.read.schema(schemas[0]).parquet(path).select(*schemas[0].names) if schemas else None), unfitted


def report_flags(samples: DataFrame, scored: DataFrame, skipped: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Whether anything restricted took part (missing counts as restricted), and the
    skipped maps with their reasons."""
    flag = samples.select(F.coalesce("restricted", F.lit(True)).alias("restricted")).unionByName(
        scored.select(F.coalesce("restricted", F.lit(False)).alias("restricted"))
    ).agg(F.coalesce(F.bool_or("restricted"), F.lit(False)).alias("restricted"))
    reasons = skipped[0]
    for more in skipped[1:]:
        reasons = reasons.unionByName(more)
    return flag, reasons
