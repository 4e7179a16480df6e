"""Operator 2: text quality by a sparse ensemble of rules.

Trees of a small forest are read as conjunctions of conditions over statistics of the text;
a lasso logistic regression keeps the few that matter; what is left is one column
expression over the statistics.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.llm import labels as labelled
from cellscape.session import stored

TREES, DEPTH = 16, 3
LASSO = 0.002
STATISTICS = ("log_words", "word_length", "new_words", "twice", "pipes", "bangs", "symbols", "digits", "capitals", "stops", "lines", "new_lines")


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and any other columns but the names made here) with STATISTICS of the whole text.

    Shares are of words or characters; NULL, empty and blank texts have zero words and all shares 0.
    """
    text = F.col("_text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"_words": words, "_lines": F.filter(F.split(text, "\n"), lambda x: x != "")})
    rows = rows.withColumns({
        "_n": F.size("_words").cast("double"), "_chars": F.length("_text").cast("double"),
        "_new": F.size(F.array_distinct("_words")).cast("double"),
        "_rows": F.size("_lines").cast("double"), "_new_rows": F.size(F.array_distinct("_lines")).cast("double"),
    })
    share = lambda pattern, of: F.regexp_count("_text", F.lit(pattern)) / F.greatest(F.col(of), F.lit(1.0))
    rows = rows.withColumns({
        "log_words": F.log1p("_n"), "word_length": F.col("_chars") / F.greatest("_n", F.lit(1.0)),
        "new_words": F.col("_new") / F.greatest("_n", F.lit(1.0)),
        "twice": share(r"(?<![^\s])(\S++)\s(?=\1(?:\s|$))", "_n"), "pipes": share(r"\|", "_n"), "bangs": share("!", "_n"),
        "symbols": share(r"[&$%#*@^~<>{}=+_\\]", "_n"), "digits": share("[0-9]", "_chars"), "capitals": share(r"\p{Lu}", "_chars"),
        "stops": share("[.?]", "_n"), "lines": F.col("_rows") / F.greatest("_n", F.lit(1.0)),
        "new_lines": F.col("_new_rows") / F.greatest("_rows", F.lit(1.0)),
    })
    return rows.drop("_text", "_words", "_lines", "_n", "_chars", "_new", "_rows", "_new_rows")


Rule = tuple[tuple[int, bool, float], ...]   # (statistic, at most?, threshold), all of which hold


def paths(node, so_far: Rule = ()) -> list[Rule]:
    """The conjunction of every node below the root of a tree; one interval for each statistic."""
    out = [so_far] if so_far else []
    if node.getClass().getSimpleName() != "LeafNode":
        at, threshold = node.split().featureIndex(), float(node.split().threshold())
        for most, child in ((True, node.leftChild()), (False, node.rightChild())):
            rest = tuple(c for c in so_far if c[:2] != (at, most))   # the newer bound is the tighter one
            out += paths(child, tuple(sorted(rest + ((at, most, threshold),))))
    return out


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for at, most, threshold in rule:
        out = out & (F.col(STATISTICS[at]) <= threshold if most else F.col(STATISTICS[at]) > threshold)
    return out


class RuleEnsemble:
    """Weighted rules and a constant; `score` is their column expression."""

    def __init__(self, rules: list[tuple[float, Rule]], constant: float):
        self.rules, self.constant = rules, constant

    def score(self) -> Column:
        margin = sum((F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.rules), F.lit(self.constant))
        return 1 / (1 + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
    """Learn from all labelled rows that are not held out.

    Statistics are joined with the labels, so no text is shuffled however many labels there are.
    Without rows of both labels the score is near the label that there is (0.5 without any).
    """
    told = statistics(docs.where(F.col("doc_id").isNotNull() & ~labelled.held_out()).select("doc_id", "text")).select("doc_id", *STATISTICS)
    rows = stored(told.join(labelled.known(labels, label), "doc_id").select(*STATISTICS, F.col("label").cast("double").alias("label")), "statistics")
    known = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(known) < 2:
        return RuleEnsemble([], {1.0: 4.0, 0.0: -4.0}[next(iter(known))] if known else 0.0)
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, minInstancesPerNode=3, featureSubsetStrategy="onethird").fit(data)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"))})
    if not rules:
        share = known[1.0] / sum(known.values())
        return RuleEnsemble([], 4.0 * (2 * share - 1))
    fired = rows.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("fired"))
    from pyspark.ml.functions import array_to_vector
    # The rarer label is as heavy as the other.
    weight = F.when(F.col("label") == 1.0, F.lit(1.0 / known[1.0])).otherwise(F.lit(1.0 / known[0.0])) * (sum(known.values()) / 2)
    data = fired.select("label", array_to_vector("fired").alias("features"), weight.alias("weight"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, weightCol="weight", maxIter=200).fit(data)
    kept = [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules) if abs(w) > 1e-6]
    return RuleEnsemble(kept, float(lasso.intercept))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    docs: doc_id, text; other columns are not read.  Whole texts are scored, NULL and empty
    ones by the statistics of no words.  Repeated rows score alike; a NULL doc_id stays NULL
    and is not held out.
    """
    rows = statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    return rows.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns as they were."""
    rows = statistics(docs.select("text", F.struct("*").alias("_row")))
    return rows.where(model.score() >= threshold).select("_row.*")
