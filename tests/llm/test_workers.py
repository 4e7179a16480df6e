"""Executors do not need the package, and no component is named after a row without an id."""

import os
import subprocess
import sys

import numpy as np

from cellscape.llm import embeddings

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import os
from pyspark.sql import functions as F
from cellscape.session import local_session
from cellscape.llm import decontaminate, embeddings, ngram_join, resample, toxicity, vector_codes

os.environ.pop("PYTHONPATH", None)
spark = local_session(2, **{"spark.driver.memory": "2g", "spark.executorEnv.PYTHONPATH": ""})
texts = [(i, f"alpha beta gamma delta word{i} word{i % 3} " * 6) for i in range(30)]
docs = spark.createDataFrame(texts, "doc_id long, text string")
marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, 0, [float(i % 4), 1.0, 0.5, 0.25, 1.0, 0.0, 1.0, 2.0]) for i in range(20)], "vec_id long, label int, embedding array<double>")
assert spark.range(1).select(F.udf(lambda x: __import__("importlib.util").util.find_spec("cellscape") is None, "boolean")("id")).first()[0]
assert embeddings.near_duplicates(vectors).count() == 20
assert vector_codes.compressed(vectors).count() == 20
assert toxicity.score(docs, toxicity.fit(docs, marks)).count() == 30
assert decontaminate.contaminated(docs, spark.createDataFrame([(1, texts[3][1])], "item_id long, text string")).count() >= 1
assert ngram_join.jaccard_components(docs).count() == 30
assert resample.drawn(docs, docs).count() == 30
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]


def test_rows_without_id_name_no_component(spark):
    """A row without an id links two vectors that do not link themselves."""
    rng = np.random.default_rng(0)
    rows = []
    for label in range(8):
        x, y = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        turn = lambda a: [float(v) for v in np.cos(a) * x + np.sin(a) * y]
        rows += [(10 * label + 5, label, turn(0.0)), (10 * label + 2, label, turn(0.36)), (None, label, turn(0.18)), (10 * label, label, turn(2.0))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).where("vec_id IS NOT NULL").collect()}
    for label in range(8):
        assert got[10 * label + 5] == (1, 10 * label + 2, False) and got[10 * label + 2] == (1, 10 * label + 2, True)
        assert got[10 * label] == (0, 10 * label, True)
