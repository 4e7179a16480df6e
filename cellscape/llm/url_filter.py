"""Operator 13: verdicts on URLs by a list of rules and by mined association rules.

A listed rule (host, path) decides its host and all subdomains; the longest wins.  The URLs
that the list decides are labels: FP-growth finds which combinations of URL tokens go with
one verdict, and rules of enough support and confidence, cleared of those that a shorter one
makes needless, judge the URLs that no listed rule fits.

Listed and mined rules lie in one inverted index: a listed rule under its host, a mined one
under the rarest of its tokens.  A URL looks up its tokens, checks what it meets, and keeps
the best: one join, and one combined aggregate to a row per URL.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.session import stored

SUPPORT = 0.005          # share of the labelled URLs that a rule must hold on, with its verdict
CONFIDENCE = 0.9
ITEMS = None             # tokens of a labelled URL that are mined, those that tell most about the verdict; None: all
WIDTH = 8                # FP-growth makes 2**tokens itemsets of a URL; beyond so many, sets are counted level by level
LONGEST = 3              # tokens of a mined rule
HOST_LABELS = 5          # host suffixes of up to so many labels are tokens, more if a listed rule has more
ELSE = "allow"           # where no rule fits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_list(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(host, path, verdict) from lines like `block example.com/de/`."""
    rows = []
    for line in lines:
        verdict, where = line.split(" ", 1)
        host, slash, path = where.partition("/")
        rows.append((host, slash + path, verdict))
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def after_scheme(url: str = "url") -> Column:
    """What follows the first `://`, empty without one."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column, url: Column, labels: int) -> Column:
    """The distinct tokens of a URL: host suffixes, path segments, file extension, parameter names."""
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        named("host=", suffixes), named("path=", F.split(path, "/")),
        named("ext=", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        named("query=", F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0)))))


def parted(urls: DataFrame, labels: int, *keep: str) -> DataFrame:
    """keep..., host, path, tokens and a number of the row."""
    rows = urls.select(*keep, F.col("url").cast("string").alias("url")).withColumns({"host": host_of(), "path": path_of()})
    return rows.select(*keep, "host", "path", tokens_of(F.col("host"), F.col("path"), F.col("url"), labels).alias("tokens"),
                       F.monotonically_increasing_id().alias("at"))


def listed_index(rules: DataFrame) -> DataFrame:
    """The inverted index of a rule list; a longer rule goes before a shorter, a longer host before a shorter one."""
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    rule = F.concat(host, path)
    return rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(F.lit("host="), host).alias("token"), path.alias("prefix"), F.array().cast("array<string>").alias("needs"),
        F.struct(F.lit(1).alias("listed"), F.length(rule).cast("double").alias("first"), F.length(host).cast("double").alias("second"),
                 F.lit(0).alias("third"), rule.alias("rule"), F.col("verdict").alias("verdict")).alias("found")).distinct()


def best(rows: DataFrame, index: DataFrame, *keep: str, with_tokens: bool = False) -> DataFrame:
    """rows of `parted` with `found`, the highest entry of the index that fits (NULL: none)."""
    entry = index.withColumnRenamed("token", "_token")
    seen = rows.select("at", *keep, "host", "path", "tokens", F.explode_outer("tokens").alias("token"))
    fits = (F.col("token") == F.col("_token")) & F.startswith("path", "prefix") & F.forall("needs", lambda t: F.array_contains("tokens", t))
    return seen.join(entry, fits, "left").groupBy("at", *keep, "host", "path").agg(
        F.max("found").alias("found"), *([F.first("tokens").alias("tokens")] if with_tokens else []))


def _subsets(longest: int) -> Column:
    """Keys of all proper subsets of a sorted antecedent."""
    keys = []
    for n in range(1, longest):
        for places in itertools.combinations(range(longest), n):
            inside = (F.size("antecedent") > places[-1]) & (F.size("antecedent") > n)
            keys.append(F.when(inside, F.array_join(F.array(*[F.get("antecedent", F.lit(p)) for p in places]), "\n")))
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


def _levels(baskets: DataFrame, known: DataFrame, least: int, longest: int) -> DataFrame:
    """antecedent (sorted), n, blocked of the sets of up to `longest` tokens that may be rules, however many tokens a row has.

    A set on whose rows one verdict always holds is a rule that no longer one can outdo, and one
    that holds too rarely with either verdict has no longer one that is frequent: neither is extended.
    baskets: at, blocked (0 or 1), picked (sorted).  known: token, n, blocked of the frequent tokens.
    """
    frequent = F.greatest(F.col("blocked"), F.col("n") - F.col("blocked")) >= least
    undecided = F.col("blocked").between(1, F.col("n") - 1)
    found = known.where(frequent).select(F.array("token").alias("antecedent"), "n", "blocked")
    opened = known.where(frequent & undecided).select("token")
    # A row, the tokens a set begins with, and those that may follow.
    rows = baskets.select("at", F.col("blocked").alias("bad"), F.array().cast("array<string>").alias("start"), F.explode("picked").alias("token")).join(opened, "token")
    for level in range(2, longest + 1):
        ends = rows.groupBy("at", "bad", "start").agg(F.array_sort(F.collect_list("token")).alias("ends"))
        sets = ends.select("at", "bad", "start", "ends", F.posexplode("ends").alias("i", "x")).select(
            "at", "bad", F.concat("start", F.array("x")).alias("start"), F.explode(F.slice("ends", F.col("i") + 2, F.size("ends"))).alias("token"))
        counted = sets.groupBy("start", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("blocked")).where(frequent)
        counted = stored(counted, "sets")
        found = found.unionByName(counted.select(F.concat("start", F.array("token")).alias("antecedent"), "n", "blocked"))
        rows = sets.join(counted.where(undecided).select("start", "token"), ["start", "token"])
        if level < longest:
            rows = stored(rows, "extended")
    return found


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, items: int | None = ITEMS, longest: int = LONGEST) -> DataFrame:
    """Association rules (antecedent, verdict, confidence, support, token): token is the rarest of the antecedent.

    labelled: at (a number of the row), tokens, verdict (block or allow; other rows are left out).
    Counts are over all labelled rows, and all tokens that are frequent enough are mined, of which there
    are not more than (tokens per URL) / support; with `items`, of each row only so many that tell most
    about the verdict (covariance with it over all rows).  FP-growth mines rows of up to WIDTH frequent
    tokens; if there are longer ones, the same sets are counted level by level.  A rule that contains
    another one of at least its confidence is dropped: whatever it fits, the other fits too and goes before it.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where("verdict IN ('block', 'allow')").select("at", "tokens", "verdict"), "labelled")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")).first()
    if not total["n"]:
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, token string")
    least = math.ceil(support * total["n"])
    said = rows.select("at", "verdict", F.explode("tokens").alias("token"))
    known = said.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    known = stored(known.where(F.col("n") >= least).select(
        "token", "n", "blocked", F.abs(F.col("blocked").cast("double") * float(total["n"]) - F.col("n").cast("double") * float(total["blocked"])).alias("tells")), "tokens")
    telling = F.array_sort(F.collect_list(F.struct((-F.col("tells")).alias("o"), "token")))
    picked = said.join(known.select("token", "tells"), "token").groupBy("at", "verdict").agg(
        (telling if items is None else F.slice(telling, 1, items))["token"].alias("picked"))
    baskets = stored(picked.select("at", (F.col("verdict") == "block").cast("int").alias("blocked"), F.array_sort("picked").alias("picked"),
                                   F.concat("picked", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "baskets")
    # Rows without a frequent token are in no basket but count for the support.
    held = baskets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("picked")).alias("widest")).first()
    share = least / max(held["n"], 1)
    if share > 1:
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, token string")
    if (held["widest"] or 0) <= WIDTH:
        found = FPGrowth(itemsCol="items", minSupport=share * (1 - 1e-9), minConfidence=confidence).fit(baskets.select("items")).associationRules
        rules = found.where(F.startswith(F.get("consequent", F.lit(0)), F.lit("=")) & (F.size("antecedent") <= longest)).select(
            F.array_sort("antecedent").alias("antecedent"), F.substring(F.get("consequent", F.lit(0)), 2, 10).alias("verdict"), "confidence", "support")
    else:
        of = known if items is None else baskets.select("blocked", F.explode("picked").alias("token")).groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
        said_by = _levels(baskets, of, least, longest).select("antecedent", "n", F.inline(F.array(
            F.struct(F.lit("block").alias("verdict"), F.col("blocked").alias("hits")),
            F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("blocked")).alias("hits")))))
        rules = said_by.select("antecedent", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(held["n"])).alias("support"), "hits").where(
            (F.col("hits") >= least) & (F.col("confidence") >= confidence)).drop("hits")
    rules = stored(rules.withColumn("key", F.array_join("antecedent", "\n")), "rules")
    shorter = rules.select("key", "confidence", F.explode(_subsets(longest)).alias("part")).join(
        rules.select(F.col("key").alias("part"), F.col("confidence").alias("has")), "part").where("has >= confidence")
    kept = rules.join(shorter, "key", "left_anti")
    rarest = kept.select("key", F.explode("antecedent").alias("token")).join(known.select("token", "n"), "token").groupBy("key").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"))
    return stored(kept.join(rarest, "key").drop("key"), "mined")


def mined_index(rules: DataFrame) -> DataFrame:
    """The inverted index of mined rules: higher confidence first, then support, then fewer tokens."""
    return rules.select("token", F.lit("").alias("prefix"), F.col("antecedent").alias("needs"), F.struct(
        F.lit(0).alias("listed"), F.col("confidence").alias("first"), F.col("support").alias("second"), (-F.size("antecedent")).alias("third"),
        F.array_join("antecedent", " ").alias("rule"), F.col("verdict").alias("verdict")).alias("found"))


def judged(pages: DataFrame, rules: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, rule (the listed one that decides, else NULL), verdict, mined (the mined rule, else NULL).

    pages: page_id, url; other columns are not read.  rules: host, path, verdict; rows with a NULL are
    left out, of equal rules with both verdicts `block` wins.  A URL that is NULL or has no `://`
    has empty host and path.  A listed rule fits its host and subdomains if the path starts with its
    path; the longest wins, of equally long ones that of the longer host.  Other URLs get the verdict
    of the mined rule of highest confidence (then support, then fewest tokens), `allow` if none fits
    or nothing is listed.  Repeated rows and NULL ids are judged like any other.
    """
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = max(HOST_LABELS, depth)
    listed = listed_index(rules)
    decided = best(parted(pages, labels), listed, with_tokens=True).where("found IS NOT NULL").select("at", "tokens", F.col("found.verdict").alias("verdict"))
    index = listed.unionByName(mined_index(mined_rules(decided, support, confidence)))
    out = best(parted(pages, labels, "page_id"), index, "page_id")
    by_list = F.coalesce(F.col("found.listed") == 1, F.lit(False))
    return out.select("page_id", "host", "path", F.when(by_list, F.col("found.rule")).alias("rule"),
                      F.coalesce("found.verdict", F.lit(ELSE)).alias("verdict"), F.when(~by_list, F.col("found.rule")).alias("mined"))
