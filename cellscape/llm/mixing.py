"""Operator 9: mix sources to target weights with exact word budgets (DataFrame functions only).

Every document gets a hash-random key; the order of the keys within a source is the order
in which the mix takes its documents.  Prefix sums of word counts are built on three levels
(256 ranges of the key, 256 ranges within each, the documents of one small range), so no
source, however large, is ever sorted or summed in one task.  Each source is then cut
exactly at its budget; a budget beyond the source's size takes whole further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscape.session import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, pattern: tuple[int, ...], ratio: float, epochs: int) -> DataFrame:
    """Per source its target in words: skey, words, target.

    Sources, in order, weigh as the pattern says, over and over, and share ratio times all
    words; none gets more than `epochs` times its size, and what it leaves goes to the
    others by weight.  With sources ordered by size over weight those at their limit come
    first, and the level of all others follows from running sums.  One row per source.
    """
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in pattern]), (place % len(pattern) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("most", (F.col("words") * epochs).cast("long"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(ratio)) * F.sum("words").over(everything) - before) / rest
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    rows = rows.withColumn("final", F.min(holds).over(everything)["level"])
    limit = F.col("most").cast("double")
    return rows.select("skey", "words", F.coalesce(F.least(limit, F.col("final") * F.col("weight")), limit).alias("target"))


def mix(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes).

    docs: doc_id, text, source; other columns are not read.  size counts the words of the
    text (NULL and blank: 0).  A NULL source is a source of its own and comes last.  taken
    is size times the whole epochs of the source, plus what the last epoch takes: whole
    documents in key order, and of the one at the cut as many words as the budget has left.
    The key depends on seed and doc_id alone, so reruns agree; rows with equal keys (one
    doc_id twice) come in order of size.  A NULL doc_id is an id like any other.  A source
    without words has target 0; an empty table gives no rows.
    """
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    named = F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = F.substring(F.md5(named.cast("binary")), 1, 16)
    measured = stored(docs.select("doc_id", skey.alias("skey"), word_count().alias("size"), key.alias("key"))
                      .withColumns({"wide": F.substring("key", 1, 2), "fine": F.substring("key", 3, 2)}), "measured")

    fine = stored(measured.groupBy("skey", "wide", "fine").agg(F.sum("size").alias("words")), "fine")
    wide = stored(fine.groupBy("skey", "wide").agg(F.sum("words").alias("words")), "wide")
    sizes = stored(wide.groupBy("skey").agg(F.sum("words").alias("words")), "sizes")
    goal = stored(targets(sizes, pattern, ratio, epochs), "targets")

    def running(by: list[str], order: str):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("words").over(w), F.lit(0))

    wide = wide.select("skey", "wide", running(["skey"], "wide").alias("ahead")).join(
        goal.withColumnRenamed("words", "source_size"), "skey")
    wide = stored(wide, "ahead")
    fine = fine.select("skey", "wide", "fine", running(["skey", "wide"], "fine").alias("within")).join(wide, ["skey", "wide"]).select(
        "skey", "wide", "fine", "source_size", "target", (F.col("ahead") + F.col("within")).alias("ahead"))
    fine = stored(fine, "ahead")

    order = Window.partitionBy("skey", "wide", "fine").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = measured.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(fine, ["skey", "wide", "fine"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(0)
    left = budget - whole * F.col("source_size")
    cut = F.least(F.greatest(left - F.col("ahead") - F.col("within"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """One row per document and epoch in which the mix takes it: the columns of `mixed`, epoch, words."""
    rows = mixed.where("taken > 0").withColumn(
        "epoch", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    return rows.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
