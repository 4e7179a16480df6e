"""Training memory: digests over sources, versions under a manifest."""

import hashlib
import os


from cellscape.operators import memory
from cellscape.session import scratch_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_revisions_fold_every_source(spark):
    contents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f"), (8, None), (9, "g")], "map_no long, hash string")
    sources = spark.createDataFrame([(3, 2), (3, 1), (3, 1), (4, 3), (5, 6), (6, 5), (9, 7)], "map_no long, source long")
    got = {r["map_no"]: r["revision"] for r in memory.source_revisions(contents, sources).collect()}
    third = sha(f"c|1:{sha('a')}|2:{sha('b')}")
    assert got == {1: sha("a"), 2: sha("b"), 3: third, 4: sha(f"d|3:{third}"), 5: None, 6: None, 7: None, 8: None, 9: None}
    assert memory.source_revisions(contents.where("1 = 0"), sources.where("1 = 0")).count() == 0


def test_changes_by_schema_and_legacy_record(spark):
    now = spark.createDataFrame([(1, "p", "r"), (2, "p", "new"), (3, "p", None)], "map_no long, painting_hash string, source_revision string")
    then = spark.createDataFrame([(1, "p", "r"), (2, "p", "old"), (4, "q", "r")], "map_no long, painting_hash string, source_revision string")
    ask = lambda record, schema: dict(map(tuple, memory.changed_training(now, record, "s", schema).collect()))
    assert ask(then, "s") == {2: "changed", 3: "added", 4: "removed"}
    assert ask(then.drop("source_revision"), "s") == {3: "added", 4: "removed"}
    assert ask(then, "other") == {1: "other schema", 2: "other schema", 3: "added", 4: "removed"}


def test_inputs_of_verified_painted_maps(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1, False), (2, 0, 0, 0, 0, False), (3, 0, 1, 1, 1, True)], "map_no long, ci int, cj int, code int, conf int, accepted boolean")
    rev = spark.createDataFrame([(1, "x"), (2, "y")], "map_no long, revision string")
    got = {r["map_no"]: r["source_revision"] for r in memory.training_inputs(cells, spark.createDataFrame([(1,), (2,)], "map_no long"), rev, 2).collect()}
    assert got == {1: "x"}            # 2 is blank, 3 is not verified


def test_memory_versions(spark):
    path = scratch_path(spark, "memory")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "map_no long, x double")
    ids = lambda *m: spark.createDataFrame([(i,) for i in m], "map_no long")
    assert memory.latest_version(spark, path) == -1
    groups = spark.createDataFrame([(i, f"g{i}") for i in range(9)], "map_no long, grp string")
    tiles = spark.createDataFrame([(5, 7)], "map_no long, tile long")
    feet = spark.createDataFrame([(i, "m", 10.0 * i, 0.0, 10.0 * i + 5, 5.0) for i in range(9)], "map_no long, crs string, l double, b double, r double, t double")

    def update(asked, fresh, verified, held=()):
        told = memory.updated(path, ids(*asked), fresh, ids(*verified), ids(*held), groups, tiles, feet)
        return {r["map_no"]: r["status"] for r in told.collect()}, sorted((r["map_no"], r["x"]) for r in memory.memory(spark, path).collect())

    assert update([1, 2, 5], rows((1, 1.0), (2, 2.0), (2, 2.5), (5, 5.0), (8, 8.0)), [1, 2, 5]) == (
        {1: "added", 2: "added", 5: "added"}, [(1, 1.0), (2, 2.0), (2, 2.5), (5, 5.0)])       # 8 was not asked for
    assert update([1, 3], rows((1, 9.0), (3, 3.0)), [1, 2, 5]) == (
        {1: "replaced", 2: "kept", 3: "refused: not verified", 5: "kept"}, [(1, 9.0), (2, 2.0), (2, 2.5), (5, 5.0)])
    assert update([2], rows(), [1, 5]) == ({1: "kept", 2: "refused: not verified", 5: "kept"}, [(1, 9.0), (5, 5.0)])
    assert update([1], rows(), [1, 5], held=[7]) == ({1: "forgotten", 5: "dropped: excluded"}, [])       # 5 was cut from tile 7
    assert update([5, 7], rows((5, 1.0), (7, 1.0)), [5, 7], held=[7]) == ({5: "refused: excluded geography", 7: "refused: held out"}, [])
    newest = memory.latest_version(spark, path)
    os.makedirs(f"{path.removeprefix('file:')}/manifest/{newest + 1}")         # a run that died before its manifest was done
    assert memory.latest_version(spark, path) == newest and memory.memory(spark, path).count() == 0
