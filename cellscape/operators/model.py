"""Weighted per-pixel classification with Spark ML.

Backends are estimators with a weight column.  Fitting sees the capped sample (at most
120,000 rows by policy); prediction is a projection over the pixel table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.functions import constants as K
from cellscape.functions.raster import all_finite
from cellscape.session import cut_lineage


def schema(backend: str = "forest") -> dict[str, Any]:
    """What a saved model must have been trained with."""
    return {
        "version": 1, "backend": backend, "classes": {str(k): v for k, v in K.UNIT_NAMES.items()},
        "features": list(K.BASE_FEATURES),
        "recipe": {"version": K.FEATURE_VERSION, "window": "gaussian", "rough_m": K.ROUGH_M, "rel_m": K.REL_M,
                   "local_m": K.LOCAL_M, "curv_m": K.CURV_M, "sky_local_m": K.SKY_LOCAL_M},
    }


def base_features(df: DataFrame, names: tuple[str, ...] = K.BASE_FEATURES) -> DataFrame:
    """P5: the required features in their fixed order; a missing or doubled name is an error."""
    doubled = sorted({n for n in df.columns if df.columns.count(n) > 1})
    missing = [n for n in names if n not in df.columns]
    if doubled or missing:
        raise ValueError(f"features missing: {missing}, doubled: {doubled}")
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *names)


def balanced(samples: DataFrame, counts: dict[int, int], label: str = "label", weight: str = "w") -> DataFrame:
    """Balanced class factor n / (k * n_c), counted without weights, times the row weight."""
    n, k = sum(counts.values()), len(counts)
    factor = F.lit(None).cast("double")
    for code, count in counts.items():
        factor = F.when(F.col(label) == code, F.lit(n / (k * count))).otherwise(factor)
    return samples.withColumn(weight, F.col(weight) * factor)


def forest(num_trees: int = 200, max_depth: int = 30, seed: int = 0) -> RandomForestClassifier:
    """M1"""
    return RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="w", numTrees=num_trees,
                                  minInstancesPerNode=5, maxDepth=max_depth, seed=seed)


def boosting(rounds: int = 120, step: float = 0.1, max_depth: int = 5, seed: int = 0) -> OneVsRest:
    """M2: Spark's boosted trees are binary, so one model per unit."""
    tree = GBTClassifier(maxIter=rounds, stepSize=step, maxDepth=max_depth, minInstancesPerNode=20, seed=seed)
    return OneVsRest(classifier=tree, labelCol="_y", featuresCol="_x", weightCol="w")


def _vectors(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="_x", handleInvalid="error").transform(df)


@dataclass
class Fitted:
    """A fitted backend, or the single unit that its training rows hold."""

    model: Model | None
    names: tuple[str, ...]
    only: int | None = None
    meta: dict[str, Any] = field(default_factory=dict)


def fit(samples: DataFrame, estimator: Estimator, names: tuple[str, ...] = K.BASE_FEATURES) -> Fitted:
    """M1/M2/M8: fit on pooled rows; no rows give no model, one unit predicts itself.

    The sample is capped by policy, so it is stored once and every pass of the learner
    reads it instead of sampling the pixels again.
    """
    rows = cut_lineage(usable_rows(samples, names).select("label", "w", *names))
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_vectors(_vectors(rows, names), {r["label"]: r["n"] for r in counted}, estimator, names)


def usable_rows(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with a unit and all features; other labels are no units."""
    return samples.where(F.col("label").isin(*K.CODES) & all_finite(*names))


def usable_vectors(samples: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """keep..., label, w and the assembled features of the usable rows, for `fit_vectors`."""
    return _vectors(usable_rows(samples, names), names).select(*keep, "label", "w", "_x")


def fit_vectors(rows: DataFrame, counts: dict[int, int], estimator: Estimator, names: tuple[str, ...]) -> Fitted:
    """`fit` on stored rows (label, w, _x) of which `counts` has the number per unit."""
    if len(counts) < 2:
        return Fitted(None, names, next(iter(counts), None))
    units = {"ml_attr": {"type": "nominal", "num_vals": max(counts)}}    # told, so that no learner looks for it
    ready = balanced(rows, counts).select((F.col("label") - 1).cast("double").alias("_y", metadata=units), "_x", "w")
    return Fitted(estimator.fit(ready), names)


def predict(fitted: Fitted, px: DataFrame) -> DataFrame:
    """M3/M4/M8: adds `prediction` and `confidence`, NULL where a feature is missing.

    Rows without terrain skip the model but stay in the result; nothing is joined back.
    """
    finite = all_finite(*fitted.names)
    if fitted.model is None:
        code = F.lit(fitted.only).cast("int")
        return px.withColumns({
            "prediction": F.when(finite, code),
            "confidence": F.when(finite & code.isNotNull(), F.lit(1.0)),
        })
    columns = px.columns
    scored = fitted.model.transform(_vectors(px.where(finite), fitted.names))
    code = (F.col("prediction") + 1).cast("int")
    if isinstance(fitted.model, OneVsRestModel):
        margins = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        total = F.aggregate(margins, F.lit(0.0), lambda a, x: a + x)
        sure = F.array_max(margins) / total
    else:
        sure = F.array_max(vector_to_array("probability"))
    known = scored.select(*columns, code.alias("prediction"), sure.alias("confidence"))
    unknown = px.where(~finite).select(
        *columns, F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("double").alias("confidence")
    )
    return known.unionByName(unknown)


def save(fitted: Fitted, path: str, backend: str = "forest") -> None:
    """The model next to the schema it was trained with."""
    fitted.model.write().overwrite().save(f"{path}/model")
    row = [(json.dumps(schema(backend), sort_keys=True), list(fitted.names))]
    _session().createDataFrame(row, "schema string, names array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def load(path: str, backend: str = "forest") -> Fitted | None:
    """The saved model; None asks for a retrain (previous feature recipe)."""
    row = _session().read.schema("schema string, names array<string>").json(f"{path}/schema").first()
    saved, wanted = json.loads(row["schema"]), schema(backend)
    if saved != wanted:
        previous = json.loads(json.dumps(wanted))
        previous["recipe"]["version"] = K.FEATURE_VERSION - 1
        if saved == previous:
            return None
        raise ValueError("the saved model uses other features or units")
    reader = OneVsRestModel if backend == "boosting" else RandomForestClassificationModel
    return Fitted(reader.load(f"{path}/model"), tuple(row["names"]))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


# -- retraining --------------------------------------------------------------


def retrain(features: DataFrame, cells: DataFrame, meta: DataFrame, estimator: Estimator, grid: int,
            per_stratum: int = K.PER_STRATUM, cap: int = K.MAX_TRAIN_ROWS,
            names: tuple[str, ...] = K.BASE_FEATURES) -> tuple[Fitted, DataFrame]:
    """M5: rebuild from the verified paintings alone; returns the model and its samples."""
    from cellscape.operators.sampling import balanced_cap, stratified
    from cellscape.operators.training import of_verified, training_pixels

    verified = of_verified(cells, meta)
    labelled = training_pixels(base_features(features, names), verified, grid)
    sampled = stratified(labelled, per_stratum).select("map_no", "r", "c", "label", "w", *names)
    return fit(balanced_cap(sampled, cap), estimator, names), sampled


def replaced_samples(memory: DataFrame, fresh: DataFrame, map_no: int, held: DataFrame) -> DataFrame:
    """M6: one map's rows replaced in the memory; a held-out map is refused."""
    if not held.where(F.col("map_no") == map_no).isEmpty():
        raise ValueError(f"map {map_no} is held out and never teaches")
    return memory.where(F.col("map_no") != map_no).unionByName(fresh.where(F.col("map_no") == map_no))
