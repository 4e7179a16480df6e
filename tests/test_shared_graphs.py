"""What several steps of a query need is worked out once."""

from cellscape.operators import graph, memory
from cellscape.plans import QUERIES


def counted(monkeypatch, module, name):
    calls, made = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (calls.append(1), made(*a, **b))[1])
    return calls


def test_both_closures_walk_one_graph(spark, monkeypatch):
    calls = counted(monkeypatch, graph, "connected_components")
    ids = lambda *m: spark.createDataFrame([(i,) for i in m], "map_no long")
    groups = spark.createDataFrame([(i, i // 2) for i in range(10)], "map_no long, grp long")
    tiles = spark.createDataFrame([(4, 1), (6, 4), (8, 8)], "map_no long, tile long")
    feet = spark.createDataFrame([(i, "m", 10.0 * i, 0.0, 10.0 * i + (10 if i == 9 else 5), 5.0) for i in range(11)], "map_no long, crs string, l double, b double, r double, t double")
    kept = graph.retained_samples(ids(*range(11)), groups, tiles, ids(0), feet)
    # 0 and 1, by tile 1 the group of 4, by tile 4 that of 6; 10 touches 9.
    assert sorted(r["map_no"] for r in kept.collect()) == [2, 3, 8, 9, 10]
    kept = graph.retained_samples(ids(*range(11)), groups, tiles, ids(10), feet)
    assert sorted(r["map_no"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7] and len(calls) == 2


def test_sources_are_graded_once_for_both_states(spark, tables, monkeypatch):
    calls = counted(monkeypatch, memory.graph, "dependency_levels")
    assert QUERIES["J14_changed_sources"](spark, tables).where("map_no in (1, 17)").count() == 2 and len(calls) == 1
