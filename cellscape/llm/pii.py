"""Operator 8: personal data, as base rules plus boosted candidates (DataFrame functions only).

Each kind has an exact base rule.  Beside it, generators of high recall propose spans that
only look like a kind; gradient-boosted trees score every proposal by its format and its
context, and a proposal is taken when its score reaches a threshold that was calibrated for
its kind on held-out proposals.  The trees learn from what the base rules decide (their
checks, such as check digits, are no features), and are compiled to column expressions, so
that all of it runs in one pass over each text, without a shuffle.

Patterns are written so that no repeated group occurs: long runs neither recurse nor retry.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.session import stored

KINDS = ("email", "ip", "card", "phone")

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A local part starts where its run of characters starts, or where the last match ended.
# The domain is extended until neither a letter nor a dot with a letter follows.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?=\.{LABEL})[A-Za-z0-9.-]*?(?!{LABEL}|\.{LABEL})"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of digits with single separators, of 13 to 19 digits from its first to its last.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RULES = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

# Proposals: (kind, pattern, what a text must contain for the pattern to be tried).
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+", r"@|\(at\)|\[at\]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[.,:]\x20?[0-9]{1,3}+){3}+(?![0-9.])", r"[0-9]\x20?[.,:]\x20?[0-9]"),
    ("card", r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,19}+(?![0-9])", r"[0-9](?:[\x20./-]{0,2}[0-9]){11}"),
    ("phone", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,15}+(?![0-9A-Za-z])", r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"),
)

PRECISION = 0.95         # that a threshold must reach on held-out proposals of its kind
LEAST_HELD = 20          # accepted held-out proposals that a threshold rests on
FEATURES = ("kind", "chars", "digits", "groups", "longest", "spaces", "dashes", "dots", "parens", "plus", "at",
            "letters", "before_word", "before_mark", "before_break", "after_word", "after_mark", "after_break")


def _matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and disjoint: array of (start, end, m, before, after), code points.

    The gaps between matches and the matches alternate, so positions are their running sums.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    pairs = F.zip_with(pairs, F.slice(gaps, 2, F.size(found)), lambda p, a: F.struct(
        F.length(p["g"]).alias("gap"), p["m"].alias("m"), F.right(p["g"], F.lit(12)).alias("before"), F.left(a, F.lit(4)).alias("after")))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,m:string,before:string,after:string>>)")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
        F.array_append(acc["out"], F.struct(
            (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"),
            x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))).alias("out"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """The check digit holds: every second digit from the right counts double."""
    d = _digits(m)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


CHECKS = {
    "email": None,
    "ip": lambda x: F.forall(F.split(x["m"], r"\."), _small_part),
    "card": lambda x: _luhn(x["m"]),
    "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
}
NEEDS = {"email": "@", "phone": "+"}
SPANS = "array<struct<start:int,end:int>>"


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"))


def _of_kind(code: int, x: Column) -> Column:
    return x["kind"] == code


def base_spans(kind: str, text: Column) -> Column:
    """Spans of the base rule of a kind, in order."""
    found = _matches(text, RULES[kind])
    if CHECKS[kind]:
        found = F.filter(found, CHECKS[kind])
    spans = F.transform(found, _span)
    tried = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")
    return F.when(tried, spans).otherwise(F.expr(f"CAST(array() AS {SPANS})"))


def _with_kind(code: Column, x: Column) -> Column:
    return F.struct(code, *[x[name].alias(name) for name in ("start", "end", "m", "before", "after")])


def proposals(text: Column) -> Column:
    """Spans of all generators: array of (kind, start, end, m, before, after); they may overlap."""
    parts = []
    for kind, pattern, need in GENERATORS:
        code = F.lit(KINDS.index(kind)).alias("kind")
        named = F.transform(_matches(text, pattern), partial(_with_kind, code))
        none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int,m:string,before:string,after:string>>)")
        parts.append(F.when(text.rlike(need), named).otherwise(none))
    return F.concat(*parts)


def features(x: Column) -> list[Column]:
    """Format of a proposal and its surroundings, in the order of FEATURES."""
    m = x["m"]
    count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    groups = F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " ")
    last, first = F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))
    is_word = lambda c: c.rlike(r"^[\p{L}0-9]$").cast("int")
    return [x["kind"], F.length(m), count("0-9"), F.size(groups),
            F.array_max(F.transform(groups, lambda g: F.length(g))), count(r"\x20"), count("-"), count("."), count("()"),
            count("+"), F.when(m.contains("@"), 1).otherwise(0), count("A-Za-z"),
            is_word(last), last.rlike("^[=:\"'#$/]$").cast("int"), F.when((last == "") | last.rlike(r"^\s$"), 1).otherwise(0),
            is_word(first), first.rlike("^[%\"'/=$]$").cast("int"), F.when((first == "") | first.rlike(r"^\s$"), 1).otherwise(0)]


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def _known(x: Column) -> Column:
    """Whether the proposal overlaps a base span of its kind."""
    out = F.lit(False)
    for i, kind in enumerate(KINDS):
        out = F.when(x["kind"] == i, _overlaps(x, F.col(f"base_{kind}"))).otherwise(out)
    return out


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.col("_text")
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    return rows.withColumns({f"base_{k}": base_spans(k, text) for k in KINDS} | {"_proposed": proposals(text)})


class Model:
    """Compiled trees: margins as nested conditions, and the score each kind must reach."""

    def __init__(self, trees: list, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, columns: list[Column]) -> Column:
        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, at, low, high = node
            return F.when(columns[feature] <= at, branch(low)).otherwise(branch(high))
        margin = sum((branch(tree) * F.lit(weight) for weight, tree in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def takes(self, x: Column, columns: list[Column]) -> Column:
        least = F.lit(None).cast("double")
        for kind, at in self.thresholds.items():
            least = F.when(x["kind"] == kind, F.lit(at)).otherwise(least)
        return F.coalesce(self.score(columns) >= least, F.lit(False))


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame) -> Model | None:
    """Learn from the proposals in all texts; None if they are all of one sort.

    Four fifths of the texts, by hash, fit the trees, the others calibrate: for each kind the
    lowest score from which on the accepted proposals are base spans to PRECISION.
    """
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1_000_000))
    rows = _prepared(docs.withColumn("_hash", hashed)).select(
        (F.pmod(F.col("_hash"), F.lit(5)) == 4).alias("held"),
        F.explode(F.transform("_proposed", lambda x: F.struct(
            F.array(*[f.cast("double") for f in features(x)]).alias("f"), _known(x).cast("double").alias("label")))).alias("x"))
    rows = rows.select("held", F.col("x.label").alias("label"), *[F.col("x.f")[i].alias(name) for i, name in enumerate(FEATURES)])
    rows = stored(rows, "proposals")
    known = rows.where("NOT held").groupBy("label").count().collect()
    if len(known) < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("NOT held")).select("features", "label")
    boosted = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(data)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(boosted.treeWeights, boosted.trees)]
    model = Model(trees, {})
    score = F.floor(model.score([F.col(name) for name in FEATURES]) * 100) / 100   # at most 101 values
    held = rows.where("held").groupBy(F.col("kind").cast("int").alias("kind"), score.alias("score")).agg(
        F.sum("label").alias("right"), F.count(F.lit(1)).alias("all")).collect()
    for kind in {r["kind"] for r in held}:
        right = total = 0
        for r in sorted((r for r in held if r["kind"] == kind), key=lambda r: -r["score"]):
            right, total = right + r["right"], total + r["all"]
            if total >= LEAST_HELD and right >= PRECISION * total:
                model.thresholds[kind] = r["score"]
    return model


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the spans of each kind in columns base_<kind> and all_<kind>, in order.

    docs: doc_id, text and any columns but those made here (base_*, all_*, _text,
    _proposed).  NULL and empty texts have no spans.  Base spans always stay; a taken
    proposal that overlaps a base span of its kind adds nothing.  Repeated rows get the same spans.
    """
    rows = _prepared(docs)
    taken = F.slice("_proposed", 1, 0)
    if model and model.thresholds:
        fresh = F.filter("_proposed", lambda x: x["kind"].isin(*model.thresholds) & ~_known(x))
        scored = F.transform(fresh, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                       F.array(*[f.cast("double") for f in features(x)]).alias("f")))
        taken = F.filter(scored, lambda x: model.takes(x, [x["f"][i] for i in range(len(FEATURES))]))
    rows = rows.withColumn("_taken", taken)
    for i, kind in enumerate(KINDS):
        extra = F.transform(F.filter("_taken", partial(_of_kind, i)), _span)
        rows = rows.withColumn(f"all_{kind}", F.array_sort(F.array_distinct(F.concat(f"base_{kind}", extra))))
    return rows.drop("_proposed", "_taken")


def _spelled(kind: str, s: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _marked(kind: str, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("mark"))


def _joined(which: str) -> Column:
    parts = [F.transform(f"{which}_{k}", partial(_spelled, k)) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and all spans as kind:start:end."""
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    spans = F.array_sort(F.concat(*[F.transform(f"all_{k}", partial(_marked, k)) for k in KINDS]))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], -s["back"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])).alias("out"))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with every span in the text replaced by its kind; n_chars, if there is one, follows the text."""
    rows = find(docs.select("text", F.struct("*").alias("_row")), model).withColumn("_clean", redacted(F.col("text")))
    columns = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[columns[c].alias(c) if c in columns else F.col("_row")[c].alias(c) for c in docs.columns])
