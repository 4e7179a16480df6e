"""Components, fixpoints and dependency order over edge tables.

Each round is a few joins and map-side combined aggregates.  Lineage is cut with tables in
the shared folder, so losing an executor never replays earlier rounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.functions.constants import GRID
from cellscape.operators.overlap import overlap_pairs
from cellscape.session import cut_lineage, drop_stored, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# What is left of a graph with so few edges is finished in one task: some MB, however large the graph was.
SMALL = 1 << 14


def _plain(value):
    """A node as a value that Python can hash."""
    return tuple(value.values()) if isinstance(value, dict) else value


def _in_one_task(edges: DataFrame, step, schema: str) -> DataFrame:
    """Run `step(rows) -> columns` over the few rows of `edges` together."""
    def run(batches):
        rows = [batch for batch in batches if batch.num_rows]
        if rows:
            yield from step(pa.Table.from_batches(rows)).to_batches()

    return edges.coalesce(1).mapInArrow(run, schema)


def _join_names(table: pa.Table) -> pa.Table:
    """(node, up): one name for all nodes that edges a-b connect."""
    kept, up = {}, {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        for node in (a, b):
            up.setdefault(_plain(node), _plain(node))
            kept.setdefault(_plain(node), node)
        up[top(_plain(a))] = top(_plain(b))
    kind = table.schema.field("a").type
    return pa.table({"node": pa.array(list(kept.values()), kind), "up": pa.array([kept[top(x)] for x in kept], kind)})


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", small: int = SMALL) -> DataFrame:
    """Smallest node of every component: (node, component), for every node that an edge names.

    The graph is contracted: each node points to its smallest neighbour, edges are renamed
    by those pointers, and what still joins two names goes into the next round.  Odd rounds
    order nodes by a hash, so that a long chain also loses a constant share of its nodes
    in each round.  A hub's edges are only reduced by `min`, which combines before the
    shuffle, and met in joins against a written table, whose skew Spark can split.
    Once `small` edges or fewer are left, one task joins their names.  A round's tables
    are deleted when the next ones are written.
    NULL ends are no nodes; an edge from a node to itself only names it.
    """
    rest = stored(
        edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    )
    kind = rest.schema["a"].dataType.simpleString()
    names, rounds = None, 0
    while True:
        last = rest.count() <= small
        if last:
            point = _in_one_task(rest, _join_names, f"node {kind}, up {kind}")
            point = point if names is None else stored(point)
        else:
            order = (lambda c: F.xxhash64(c, F.lit(rounds))) if rounds % 2 else (lambda c: c)
            ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
                rest.select("a", F.col("a").alias("b")))
            ends = ends.unionByName(rest.select(F.col("b").alias("a"), "b"))
            point = stored(ends.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), "b")).alias("m"))
                           .select(F.col("a").alias("node"), F.col("m.b").alias("up")))
        older = names
        if names is None:
            names = stored(point.select("node", F.col("up").alias("top")))
        else:
            names = stored(names.join(point.withColumnRenamed("node", "top"), "top", "left").select(
                "node", F.coalesce("up", "top").alias("top")))
            drop_stored(older)
        if last:
            drop_stored(rest, point)
            break
        left = rest.join(point.select(F.col("node").alias("a"), F.col("up").alias("pa")), "a").join(
            point.select(F.col("node").alias("b"), F.col("up").alias("pb")), "b")
        older, rest = rest, stored(left.where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_stored(older, point)
        rounds += 1
    lowest = names.groupBy("top").agg(F.min("node").alias("component"))
    out = stored(names.join(lowest, "top").select("node", "component"))
    drop_stored(names)
    return out


def _settle_rows(top: int | None):
    def step(table: pa.Table) -> pa.Table:
        """The rounds of `settled` on the few rows left: (node, value) of whatever gets a value."""
        base, needs, users, kept = {}, {}, {}, {}
        for u, d, w, b in zip(*(table.column(c).to_pylist() for c in ("u", "d", "w", "base"))):
            kept[_plain(u)] = u
            if d is None:
                base[_plain(u)] = b
            else:
                needs.setdefault(_plain(u), {})[_plain(d)] = w
                users.setdefault(_plain(d), []).append(_plain(u))
        ready = [u for u in base if not needs.get(u) or base[u] == top]
        value = {}
        while ready:
            u = ready.pop()
            if u in value:
                continue
            value[u] = base[u]
            for user in users.get(u, ()):
                w = needs[user].pop(u, None)
                if user not in value and w is not None:
                    base[user] = max(base[user], value[u] + w)
                    if not needs[user] or base[user] == top:
                        ready.append(user)
        return pa.table({"node": pa.array([kept[u] for u in value], table.schema.field("u").type), "value": pa.array(list(value.values()), pa.int64())})

    return step


LONGEST_PATH = 1 << 50    # lengths stop growing there, which only paths around a cycle reach


def settled(nodes: DataFrame, edges: DataFrame, top: int | None = None, small: int = SMALL) -> DataFrame:
    """value(u) = max(base(u), value(d) + w over the edges u, d, w): (node, value).

    nodes: node, base.  edges: u, d, w, both ends among the nodes.  NULL where a cycle keeps
    the value open; where values cannot exceed `top`, a node that has it waits for nothing.

    A node without open edges has its base as value, which goes into the bases of its users.
    A node with one open edge is only a pointer, so every edge that leads to it leads on to
    where it points: chains halve in every round, and rounds grow with the logarithm of their
    length.  An edge may so be led to a node that gets its value in the same round, and takes
    it in the next one.  When no node of a round gets its value, none of the rest ever will.
    """
    pieces: list[DataFrame] = []
    left = stored(nodes.groupBy("node").agg(F.max("base").cast("bigint").alias("base")))
    loops = "true" if top is None else "u <> d"     # a value that depends on itself alone stays as it is, if it cannot grow
    open_ = stored(edges.where(loops).groupBy("u", "d").agg(F.max("w").cast("bigint").alias("w")))
    fresh = left.limit(0)       # nodes that got their value in the round before
    while True:
        if open_.count() + left.count() + fresh.count() <= small:
            rows = open_.select("u", "d", "w", F.lit(None).cast("bigint").alias("base")).unionByName(left.unionByName(fresh).select(
                F.col("node").alias("u"), F.lit(None).cast(open_.schema["d"].dataType).alias("d"), F.lit(None).cast("bigint").alias("w"), "base"))
            kind = left.schema["node"].dataType.simpleString()
            done = stored(_in_one_task(rows, _settle_rows(top), f"node {kind}, value bigint"))
            pieces.append(left.join(done, "node", "left").select("node", "value"))
            break
        out = open_.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.first("d").alias("to"), F.first("w").alias("by"))
        state = left.join(out.withColumnRenamed("u", "node"), "node", "left").join(
            fresh.select(F.col("node").alias("to"), F.lit(True).alias("over")), "to", "left")
        ready = F.col("n").isNull() if top is None else F.col("n").isNull() | (F.col("base") == top)
        state = stored(state.select("node", "base", ready.alias("ready"), F.when((F.col("n") == 1) & F.col("over").isNull(), F.col("to")).alias("to"), "by"))
        done = state.where("ready").select("node", F.col("base").alias("value"))
        if done.isEmpty():
            pieces.append(left.select("node", F.lit(None).cast("bigint").alias("value")))
            drop_stored(state)
            break
        waiting = open_.join(state.where("ready").select(F.col("node").alias("u")), "u", "left_anti")
        known = state.where("ready or to is not null").select("node", "base", "ready", "to", "by").unionByName(
            fresh.withColumn("ready", F.lit(True)), allowMissingColumns=True)
        met = waiting.join(known.withColumnsRenamed({"node": "d", "base": "gain"}), "d", "left")
        met = stored(met.select(
            "u", (F.col("gain") + F.col("w")).alias("gain"),
            F.when(F.coalesce("ready", F.lit(False)), None).otherwise(F.coalesce("to", "d")).alias("d"),
            F.least(F.col("w") + F.when(F.col("to").isNotNull(), F.col("by")).otherwise(0), F.lit(LONGEST_PATH)).alias("w")))
        gained = met.where("gain is not null").groupBy(F.col("u").alias("node")).agg(F.max("gain").alias("gain"))
        older = left, open_
        left = stored(state.where("not ready").select("node", "base").join(gained, "node", "left").select(
            "node", F.greatest("base", F.when(F.col("gain") > LONGEST_PATH, LONGEST_PATH).otherwise(F.col("gain"))).alias("base")))
        open_ = stored(met.where("d is not null").where(loops).groupBy("u", "d").agg(F.max("w").alias("w")))
        drop_stored(met, *older)
        fresh = state.where("ready").select("node", "base")
        pieces.append(done)
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    return whole


def canonical_names(links: DataFrame) -> DataFrame:
    """One spelling per alias component: highest priority, then smallest name.

    `links`: alias, grp, priority; the priority belongs to the group spelling.  An alias
    without a group (NULL) that nothing else names is its own spelling.
    """
    comp = connected_components(links, "alias", "grp")
    rank = links.groupBy(F.col("grp").alias("node")).agg(F.max("priority").alias("priority"))
    named = comp.join(rank, "node", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    best = named.groupBy("component").agg(F.min(F.struct((-F.col("priority")).alias("p"), "node")).alias("best"))
    lone = links.select("alias").where("alias is not null").distinct().join(comp.withColumnRenamed("node", "alias"), "alias", "left_anti")
    return comp.join(best, "component").select(F.col("node").alias("alias"), F.col("best.node").alias("canonical")).unionByName(
        lone.withColumn("canonical", F.col("alias")))


def _node(kind: str, c: str):
    return F.concat(F.lit(kind), F.col(c).cast("string"))


def exclusion_graph(groups: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, links) of `blocked_maps`, the same whatever is held: map_no, component; u, d, w.

    Groups that share a map stand or fall together, so they are one node of a graph whose
    edges lead from the tiles' groups to the groups of the samples cut from them.
    """
    named = groups.where("map_no is not null and grp is not null").select("map_no", _node("map ", "map_no").alias("u"), _node("group ", "grp").alias("v"))
    merged = connected_components(named)
    placed = stored(named.select("map_no", "u").distinct().join(merged.withColumnRenamed("node", "u"), "u").select("map_no", "component"))
    links = tiles.select("map_no", "tile").distinct().join(placed.withColumnRenamed("component", "u"), "map_no")
    ends = tiles.select("tile").distinct().join(placed.withColumnRenamed("map_no", "tile"), "tile", "left").select(
        "tile", F.coalesce("component", _node("map ", "tile")).alias("d"))
    return placed, stored(links.join(ends, "tile").where("u <> d").select("u", "d", F.lit(0).alias("w")).distinct())


def blocked_maps(groups: DataFrame, tiles: DataFrame, held: DataFrame, prepared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """G3 (closure): maps and groups shut out by the held-out maps.

    groups: map_no, grp of every known map.  tiles: map_no, tile (tiles a sample was cut
    from).  held: map_no.  A blocked group holds all its maps; a held tile blocks the
    group of every sample cut from it.  prepared: `exclusion_graph` of these groups and tiles.

    What a held map reaches in the exclusion graph is blocked.
    """
    placed, links = prepared or exclusion_graph(groups, tiles)
    known = stored(held.select("map_no").distinct())
    start = known.join(placed, "map_no", "left").select(F.coalesce("component", _node("map ", "map_no")).alias("node")).distinct()
    out = reached(start, links).withColumnRenamed("node", "component")
    return stored(placed.join(out, "component", "left_semi").select("map_no").unionByName(known).distinct())


def reached(start: DataFrame, links: DataFrame) -> DataFrame:
    """The start nodes and all that depend on them: (node).  start: node.  links: u, d, w; u depends on d."""
    nodes = start.select("node", F.lit(1).alias("base")).unionByName(links.select(
        F.explode(F.array("u", "d")).alias("node"), F.lit(0).alias("base")))
    return settled(nodes, links, top=1).where("value = 1").select("node")


def retained_samples(samples: DataFrame, groups: DataFrame, tiles: DataFrame, held: DataFrame,
                     footprints: DataFrame) -> DataFrame:
    """Training samples left after keys, geographies, tiles and footprints are excluded.

    footprints: map_no, crs, l, b, r, t of samples and held-out maps alike.  What cannot be
    placed cannot be cleared: a sample without CRS or bounds is not retained, and a
    shut-out map without them is an error.
    """
    from cellscape.operators.overlap import overlapping, placeable

    prepared = exclusion_graph(groups, tiles)     # both closures walk the same graph
    first = blocked_maps(groups, tiles, held, prepared)
    lost = footprints.where(~placeable()).join(first, "map_no", "left_semi").select("map_no").limit(1).collect()
    if lost:
        raise ValueError(f"held-out map {lost[0]['map_no']} has no usable footprint")
    blind = samples.join(footprints.where(placeable()), "map_no", "left_anti").select("map_no")
    out = footprints.join(first, "map_no", "left_semi")
    rest = footprints.join(first, "map_no", "left_anti").join(samples.select("map_no"), "map_no", "left_semi")
    hit = overlapping(rest, out, True, ["crs"]).select("map_no")
    second = blocked_maps(groups, tiles, first.unionByName(hit), prepared)
    return samples.join(second.unionByName(blind).distinct(), "map_no", "left_anti")


def tile_adjacency(tiles: DataFrame) -> DataFrame:
    """Pairs of aligned tiles that share an edge (not just a corner) or overlap.

    tiles: map_no, crs, transform, height, width.  Adds lattice positions top/left.
    """
    placed = on_lattice(tiles)
    boxes = placed.select("map_no", "lattice", F.col("left").alias("l"), F.col("top").alias("b"),
                          (F.col("left") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("t"))
    near = overlap_pairs(boxes, boxes, "map_no", "map_no", inclusive=True, keys=["lattice"])
    p, q = F.col("_p"), F.col("_q")
    dx = F.least(p["r"], q["r"]) - F.greatest(p["l"], q["l"])
    dy = F.least(p["t"], q["t"]) - F.greatest(p["b"], q["b"])
    return (
        near.where("map_no < map_no_2")
        .withColumns({"dx": dx, "dy": dy})
        .where("(dy > 0 and dx >= 0) or (dy >= 0 and dx > 0)")
        .select("map_no", "map_no_2", F.expr("dx > 0 and dy > 0").alias("overlap"))
    )


def on_lattice(tiles: DataFrame) -> DataFrame:
    """Whole-pixel position of each tile on the lattice of its CRS, spacing and phase."""
    t = F.col("transform")
    x, y = t[2] / t[0], t[5] / t[4]

    def phase(v):
        return F.pmod(F.round(v - F.floor(v), 6), F.lit(1.0))

    usable = F.col("crs").isNotNull() & (t[1] == 0) & (t[3] == 0) & (t[0] > 0) & (t[4] < 0)
    return tiles.where(usable).select(
        "map_no", "height", "width",
        F.concat_ws("|", "crs", t[0].cast("string"), t[4].cast("string"),
                    phase(x).cast("string"), phase(y).cast("string")).alias("lattice"),
        F.rint(x - phase(x)).cast("bigint").alias("left"),
        F.rint(y - phase(y)).cast("bigint").alias("top"),
    )


def tile_contexts(tiles: DataFrame) -> DataFrame:
    """Groups of two or more joined tiles; a group with any overlap is left apart."""
    edges = stored(tile_adjacency(tiles), "adjoining")
    comp = connected_components(edges, "map_no", "map_no_2")
    clash = (
        edges.where("overlap").join(comp.select(F.col("node").alias("map_no"), "component"), "map_no")
        .select("component").distinct()
    )
    good = comp.join(clash, "component", "left_anti").select(F.col("node").alias("map_no"), F.col("component").alias("context"))
    # A row per tile: as small as the catalog, and read by every later step; Spark sees the size of a written table.
    return stored(on_lattice(tiles).join(good, "map_no").select("map_no", "context", "top", "left", "height", "width"), "contexts")


def dependency_levels(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Build order of feature sources: (node, level); NULL level where a cycle blocks it.

    edges: node, dep.  A node's level is one above the highest of its sources', 0 without any.
    """
    links = edges.select(F.col("node").alias("u"), F.col("dep").alias("d"), F.lit(1).alias("w"))
    every = nodes.select("node").unionByName(links.select(F.col("u").alias("node"))).unionByName(links.select(F.col("d").alias("node")))
    out = settled(every.withColumn("base", F.lit(0)), links, small=small)
    return out.select("node", F.col("value").cast("int").alias("level"))


# -- components of a cell grid -------------------------------------------------


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Four-neighbour components of equal values inside one block, by pointer jumping."""
    i, j = pdf["ci"].to_numpy(), pdf["cj"].to_numpy()
    i0, j0 = i.min(), j.min()
    shape = (int(i.max() - i0) + 1, int(j.max() - j0) + 1)
    code = np.full(shape, -1, np.int64)
    code[i - i0, j - j0] = pdf["value"].fillna(-1).to_numpy().astype(np.int64)
    label = np.arange(code.size).reshape(shape)
    down, right = (code[1:] == code[:-1]), (code[:, 1:] == code[:, :-1])
    far = code.size
    while True:
        low = label.copy()
        low[1:] = np.minimum(low[1:], np.where(down, label[:-1], far))
        low[:-1] = np.minimum(low[:-1], np.where(down, label[1:], far))
        low[:, 1:] = np.minimum(low[:, 1:], np.where(right, label[:, :-1], far))
        low[:, :-1] = np.minimum(low[:, :-1], np.where(right, label[:, 1:], far))
        low = low.ravel()[low]
        if (low == label).all():
            break
        label = low
    root = label[i - i0, j - j0]
    out = pdf[["map_no", "ci", "cj", "value"]].copy()
    out["ri"], out["rj"] = root // shape[1] + i0, root % shape[1] + j0
    return out


def grid_components(cells: DataFrame, value: str, block: int = GRID) -> DataFrame:
    """G1: 4-neighbour components of equal, non-NULL values: adds (ri, rj), the root cell.

    Blocks are labelled apart and joined through their borders; where no equal cells meet
    across a border (a painting of at most GRID*GRID cells has none) nothing is joined.
    """
    src = cells.where(F.col(value).isNotNull()).select(
        "map_no", F.col("ci").cast("bigint").alias("ci"), F.col("cj").cast("bigint").alias("cj"),
        F.col(value).cast("bigint").alias("value"),
    )
    key = cells.schema["map_no"].dataType.simpleString()
    schema = f"map_no {key}, ci bigint, cj bigint, value bigint, ri bigint, rj bigint"
    parts = src.groupBy("map_no", F.floor(F.col("ci") / block), F.floor(F.col("cj") / block)).applyInPandas(
        _label_block, schema
    )
    parts = cut_lineage(parts)
    root = F.struct("map_no", "ri", "rj")
    rim = parts.select("map_no", "ci", "cj", "value", root.alias("u"))
    edges = None
    for di, dj, at_edge in ((1, 0, F.col("ci") % block == 0), (0, 1, F.col("cj") % block == 0)):
        far = rim.where(at_edge).select(
            "map_no", (F.col("ci") - di).alias("ci"), (F.col("cj") - dj).alias("cj"), "value", F.col("u").alias("v")
        )
        met = rim.join(far, ["map_no", "ci", "cj", "value"]).select("u", "v").distinct()
        edges = met if edges is None else edges.unionByName(met)
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return parts
    merged = connected_components(edges)
    return (
        parts.withColumn("node", root).join(merged, "node", "left")
        .select("map_no", "ci", "cj", "value",
                F.coalesce("component.ri", "ri").alias("ri"), F.coalesce("component.rj", "rj").alias("rj"))
    )


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("map_no", "ri", "rj").agg(F.count(F.lit(1)).alias("cells"))
