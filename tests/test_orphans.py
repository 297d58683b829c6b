"""Orphans against a row-by-row model, and their edge cases."""

import random

from pyspark.sql import functions as F

from quernel.operators.orphans import edge_ends, orphan_cascade
from tests.conftest import at, rows

EDGES = "pos bigint, source_id string, target_id string, type string, written_at timestamp_ntz, id string, level int, day string"
NODES = "pos bigint, id string, status string, written_at timestamp_ntz, live string, at string"
CATALOG = "id string, pos int"


def edge(pos, s, t, kind="uses", when="2025-01-02 00:00:00"):
    return (pos, s, t, kind, at(when), "clash", 9, "clash")


def node(pos, i, status=None, when="2025-01-01 00:00:00"):
    return (pos, i, status, at(when), "clash", "clash")


def run(spark, edges, nodes, catalog=(("cat", 1),)):
    return orphan_cascade(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(catalog, CATALOG))


def direct(o):
    return rows(o.ends.where("level = 0").select("pos", "endpoint"))


def test_as_of(spark):
    nodes = [node(1, "a"), node(2, "a", "archived", "2025-01-03 00:00:00"), node(3, "a", None, "2025-01-05 00:00:00"), node(4, "b", None, "2025-01-02 12:00:00"), node(5, "c", "archived"), node(6, "c", "active")]
    edges = [
        edge(1, "cat", "a"), edge(2, "cat", "a", when="2025-01-03 00:00:00"), edge(3, "cat", "a", when="2025-01-04 00:00:00"), edge(4, "cat", "a", when="2025-01-06 00:00:00"),
        edge(5, "cat", "b", when="2025-01-02 11:59:59"), edge(6, "cat", "b", when="2025-01-02 12:00:00"), edge(7, "c", "cat"), edge(8, None, ""), edge(9, "cat", "A"), edge(9, "cat", "A"),
    ]
    assert sorted(set(direct(run(spark, edges, nodes)))) == [(2, "target_id"), (3, "target_id"), (5, "target_id"), (9, "target_id")]


def test_nulls_and_empty(spark):
    assert direct(run(spark, [edge(1, "x", "cat", None, None)], [])) == [(1, "source_id")]
    assert direct(run(spark, [edge(1, "x", None, None, None), edge(2, "y", "y", None, "2025-01-01 00:00:00")], [node(1, "x", None, None), node(2, None), node(3, "y", None, None)])) == []
    assert direct(run(spark, [], [node(1, "a")])) == []
    assert direct(run(spark, [edge(1, "q", "r")], [], [])) == [(1, "source_id"), (1, "target_id")]
    assert edge_ends(spark.createDataFrame([], EDGES)).count() == 0


def test_cascade(spark):
    nodes = [node(k, i) for k, i in enumerate("abcdef")]
    edges = [edge(1, "a", "gone", "part_of"), edge(2, "b", "a", "part_of"), edge(3, "c", "b", "belongs_to"), edge(4, "d", "c", "uses"), edge(5, "e", "cat", "part_of"), edge(6, "c", "a", "part_of")]
    o = run(spark, edges, nodes)
    assert rows(o.entities) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(o.ends.where("level > 0").select("pos", "endpoint")) == [(1, "source_id"), (2, "source_id"), (2, "target_id"), (3, "source_id"), (3, "target_id"), (4, "target_id"), (6, "source_id"), (6, "target_id")]
    report = o.report().collect()
    assert sum(r.direct for r in report) == 1 and sum(r.inherited for r in report) == 8 and {r.period for r in report} == {"2025-01-01"}


def test_model_with_hot_ids(spark):
    rnd = random.Random(3)
    day = lambda: f"2025-01-{rnd.randint(1, 28):02} {rnd.randint(0, 23):02}:00:00"
    ids = ["hot"] * 6 + [f"n{k}" for k in range(8)]
    nodes = [node(k, rnd.choice(ids), rnd.choice([None, "active", "archived"]), day()) for k in range(300)]
    edges = [edge(k, rnd.choice(ids), rnd.choice(ids), when=day()) for k in range(400)]
    want = []
    for e in edges:
        for name, i in (("source_id", e[1]), ("target_id", e[2])):
            before = [n for n in nodes if n[1] == i and n[3] <= e[4]]
            if not before or max(before, key=lambda n: (n[3], n[0]))[2] == "archived":
                want.append((e[0], name))
    assert direct(run(spark, edges, nodes)) == sorted(want, key=repr)


def test_names_kept(spark):
    o = run(spark, [edge(1, "q", "cat")], [])
    assert o.ends.columns == ["pos", "endpoint", "id", "type", "written_at", "level"]
    assert o.ends.select(F.max("id")).first()[0] == "q"
