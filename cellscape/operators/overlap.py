"""Footprint overlap joins.

A range predicate alone plans as a nested loop.  Here every box is filed under the one
power-of-two lattice that fits its size (at most four cells), and looks up the other
side in the lattices that side really uses, so a pair meets in an equi-join on
(level, x, y).  Boxes of very different size cost one cell per level, not an explosion.
A cell that more than CROWD boxes of one side share is dealt into blocks, by position on a
finer lattice, and the boxes of the other side that reach a block are filed there.

Only distinct geometries take part: a group of copies of one footprint counts once,
and ids are joined back by geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.session import stored

BOX = ("l", "b", "r", "t")
CELL = ["level", "x", "y"]
CROWD = 1024             # boxes of one side that may meet the other side in one block
DEEPEST = 12             # times that a crowded cell is halved; what is still crowded is dealt by hash


def _level(width: Column, height: Column) -> Column:
    """The power of two that is no less than either side of a box."""
    span = F.greatest(width, height)
    return F.when(span > 0, F.ceil(F.log2(span))).otherwise(-30).cast("int")


def _leveled(boxes: DataFrame, extra: list[str]) -> DataFrame:
    level = _level(F.col("r") - F.col("l"), F.col("t") - F.col("b"))
    return boxes.select(*extra, *[F.col(x).cast("double").alias(x) for x in BOX]).distinct().withColumn("lvl", level)


def _filed(boxes: DataFrame, levels: Column, prefix: str, extra: list[str]) -> DataFrame:
    """One row per lattice cell that a box touches on each of `levels`."""
    size = F.pow(F.lit(2.0), F.col("level"))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    at = boxes.withColumn("level", F.explode(levels)).withColumn("x", F.explode(span("l", "r")))
    return at.withColumn("y", F.explode(span("b", "t"))).select(
        *extra, "level", "x", "y", F.struct(*BOX).alias(prefix)
    )


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """Both directions of the look-up: `a` in the lattices of larger `b`, and the reverse."""
    pa, pb = _leveled(a, keys), _leveled(b, keys)
    own = F.array("lvl")
    # Binary exponents of box sizes: a few dozen values at most, whatever the row count.
    seen_a = pa.withColumn("used", pb.agg(F.collect_set("lvl")).scalar())
    seen_b = pb.withColumn("used", pa.agg(F.collect_set("lvl")).scalar())
    return [
        (_filed(seen_a, F.filter("used", lambda v: v >= F.col("lvl")), "p", keys), _filed(pb, own, "q", keys)),
        (_filed(pa, own, "p", keys), _filed(seen_b, F.filter("used", lambda v: v > F.col("lvl")), "q", keys)),
    ]


def _uncrowded(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns of a finer key, on which they meet in blocks of CROWD boxes or so.

    The quadtree below a crowded cell is cut at one depth: that at which its boxes, if they
    lay evenly, would fill its squares by half.  A box is filed in every square it touches, and
    a pair counts in that of its lower-left common corner.  Squares that are crowded all the
    same (heaps of boxes on one spot) are dealt by hash, both sides, block by block.
    """
    cell = [*keys, *CELL]
    count = lambda df, by, n, *more: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n), *more)
    largest = F.max(_level(F.col("p.r") - F.col("p.l"), F.col("p.t") - F.col("p.b"))).alias("_lvl")
    # Squares are no smaller than the boxes looking up, or each would lie in many of them.
    depth = F.least(F.lit(DEEPEST), F.ceil(F.log2(F.greatest("_n", "_m") * 2 / CROWD) / 2), F.col("level") - F.col("_lvl"))
    full = stored(count(left, cell, "_n", largest).join(count(right, cell, "_m"), cell).where(F.greatest("_n", "_m") > CROWD).select(
        *cell, F.greatest(F.lit(0), depth).cast("int").alias("_deep")), "crowded")
    if full.isEmpty():
        return left, right, cell
    deep = F.coalesce("_deep", F.lit(0))
    fine = F.pow(F.lit(2.0), F.col("level") - deep)

    def squares(df: DataFrame, box: str) -> DataFrame:
        def span(lo: str, hi: str, at: str) -> Column:
            first, last = F.floor(F.col(f"{box}.{lo}") / fine), F.floor(F.col(f"{box}.{hi}") / fine)
            many = F.pow(F.lit(2.0), deep).cast("bigint")
            return F.sequence(F.greatest(first, F.col(at) * many), F.least(last, (F.col(at) + 1) * many - 1))

        out = df.join(full, cell, "left").withColumn("_fine", fine)
        return out.withColumn("_x", F.explode(span("l", "r", "x"))).withColumn("_y", F.explode(span("b", "t", "y"))).drop("_deep")

    left, right = squares(left, "p"), squares(right, "q")
    square = [*cell, "_x", "_y"]
    heap = stored(count(left, square, "_n").join(count(right, square, "_m"), square).where(F.greatest("_n", "_m") > CROWD).select(
        *square, F.ceil(F.col("_n") / CROWD).alias("_ways"), F.ceil(F.col("_m") / CROWD).alias("_turns")), "heaps")
    if heap.isEmpty():
        return left, right, square
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, F.lit(1)) - 1))
    own = lambda box, n: F.pmod(F.xxhash64(box), F.coalesce(n, F.lit(1)).cast("bigint"))
    left = left.join(heap, square, "left").withColumn("_i", own("p", "_ways")).withColumn("_j", every("_turns"))
    right = right.join(heap, square, "left").withColumn("_j", own("q", "_turns")).withColumn("_i", every("_ways"))
    return left.drop("_ways", "_turns"), right.drop("_ways", "_turns"), [*square, "_i", "_j"]


def _meets(p: Column, q: Column, inclusive: bool) -> Column:
    if inclusive:
        return (p["l"] <= q["r"]) & (p["r"] >= q["l"]) & (p["b"] <= q["t"]) & (p["t"] >= q["b"])
    return (p["l"] < q["r"]) & (p["r"] > q["l"]) & (p["b"] < q["t"]) & (p["t"] > q["b"])


def geometry_pairs(a: DataFrame, b: DataFrame, inclusive: bool, keys: list[str] | None = None) -> DataFrame:
    """Overlapping pairs of distinct boxes as structs `p` and `q` (plus the equality keys)."""
    keys = list(keys or [])
    p, q = F.col("p"), F.col("q")
    found = []
    for left, right in _sides(a, b, keys):
        left, right, met = _uncrowded(left, right, keys)
        size, x, y = F.pow(F.lit(2.0), F.col("level")), "x", "y"
        if "_x" in met:
            size, x, y, right = F.col("_fine"), "_x", "_y", right.drop("_fine")
        # A pair is reported only in the cell of its lower-left common corner.
        once = (F.floor(F.greatest(p["l"], q["l"]) / size) == F.col(x)) & (F.floor(F.greatest(p["b"], q["b"]) / size) == F.col(y))
        found.append(left.join(right, met).where(_meets(p, q, inclusive) & once).select(*keys, "p", "q"))
    return found[0].unionByName(found[1])


def _corners(name: str) -> list[Column]:
    return [F.col(f"{name}.{x}").alias(x) for x in BOX]


def overlap_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, inclusive: bool = False,
                  keys: list[str] | None = None) -> DataFrame:
    """Every overlapping (a, b) pair of ids; the output is as large as the answer."""
    keys = list(keys or [])
    pairs = geometry_pairs(a, b, inclusive, keys)
    left = a.select(*keys, F.col(a_id).alias("_a"), F.struct(*[F.col(x).cast("double").alias(x) for x in BOX]).alias("_p"))
    right = b.select(*keys, F.col(b_id).alias("_b"), F.struct(*[F.col(x).cast("double").alias(x) for x in BOX]).alias("_q"))
    slim = pairs.select(*keys, F.struct(*_corners("p")).alias("_p"), F.struct(*_corners("q")).alias("_q"))
    return (
        slim.join(left, [*keys, "_p"]).join(right, [*keys, "_q"])
        .select(*keys, F.col("_a").alias(a_id), F.col("_b").alias(b_id if b_id != a_id else f"{b_id}_2"), "_p", "_q")
    )


def overlapping(a: DataFrame, b: DataFrame, inclusive: bool, keys: list[str] | None = None) -> DataFrame:
    """Rows of `a` that overlap any row of `b`.  A semi join stops at a box's first hit, so
    crowded ground costs no more than its boxes; no pair is ever formed."""
    keys = list(keys or [])
    hits = []
    for left, right in _sides(a, b, keys):
        left, right, met = _uncrowded(left, right, keys)
        l, r = left.alias("l"), right.alias("r")
        same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in met]
        test = _meets(F.col("l.p"), F.col("r.q"), inclusive)
        for part in same:
            test = test & part
        hits.append(l.join(r, test, "left_semi").select(*keys, *_corners("p")))
    touched = hits[0].unionByName(hits[1]).distinct()
    cast = a.withColumns({x: F.col(x).cast("double") for x in BOX})
    return cast.join(touched, [*keys, *BOX], "left_semi").select(*a.columns)


def held_out(extents: DataFrame, names: DataFrame, map_id: str = "map_no") -> DataFrame:
    """The named maps and every map that strictly overlaps one grown by half its width."""
    margin = (F.col("r") - F.col("l")) / 2
    grown = extents.join(names, map_id, "left_semi").select(
        (F.col("l") - margin).alias("l"), (F.col("b") - margin).alias("b"),
        (F.col("r") + margin).alias("r"), (F.col("t") + margin).alias("t"),
    )
    near = overlapping(extents, grown, inclusive=False).select(map_id)
    return names.select(map_id).unionByName(near).distinct()


def placeable() -> Column:
    """CRS and all four bounds are known."""
    known = F.col("crs").isNotNull()
    for x in BOX:
        known = known & F.col(x).isNotNull()
    return known


def footprint_conflicts(samples: DataFrame, held: DataFrame) -> DataFrame:
    """Samples whose footprint meets a held-out one, touching included.

    Both sides: id, crs, l, b, r, t.  A missing CRS or bound is an error row, on the
    held-out side too: against such a map no sample can be cleared.
    """
    complete = placeable()
    bad = samples.where(~complete).select("id", F.lit("no usable footprint").alias("status")).unionByName(
        held.where(~complete).select("id", F.lit("held-out map without usable footprint").alias("status")))
    hit = overlapping(samples.where(complete), held.where(complete), True, ["crs"])
    return hit.select("id", F.lit("excluded").alias("status")).unionByName(bad)


def contested_pixels(claims: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Target pixels claimed by more than one source."""
    return (
        claims.groupBy(*keys)
        .agg(F.min(source).alias("first_source"), F.max(source).alias("last_source"))
        .where("first_source <> last_source")
    )
