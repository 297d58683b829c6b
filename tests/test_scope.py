"""Scoping on a graph of two sessions, and the order-dependent claims."""

from quernel.operators import scope
from tests.conftest import rows

NODES = "pos bigint, id string, type string, label string, status string, tags array<string>"
EDGES = "pos bigint, source_id string, target_id string, type string, weight double, tags array<string>"
A, B = "session-a", "session-b"


def nodes(spark, items):
    return spark.createDataFrame([(k, i, t, i, s, tags) for k, (i, t, s, tags) in enumerate(items)], NODES)


def edges(spark, items):
    return spark.createDataFrame([(k, s, t, kind, None, tags) for k, (s, t, kind, tags) in enumerate(items)], EDGES)


NODE_ROWS = [
    ("mill", "PRODUCT", None, [A]), ("weir", "ORG", None, [A]), ("lock", "PRODUCT", None, [A]), ("dyke", "PRODUCT", None, [B]), ("loose", "CONCEPT", None, None),
    ("d1", "decision", None, None), ("d2", "decision", None, None), ("d3", "decision", None, None), ("cat1", "category", None, None), ("maker", "decision_maker", None, None), ("gone", "ORG", "archived", [A]),
]
EDGE_ROWS = [
    ("mill", "lock", "uses", [A]), ("mill", "weir", "supports", [A]), ("dyke", "lock", "uses", [B]), ("d1", "mill", "involves", None), ("d1", "lock", "involves", None), ("d1", "cat1", "belongs_to", None), ("d1", "maker", "made_by", None), ("d2", "maker", "made_by", None), ("mill", "gone", "uses", [A]),
]


def test_sessions(spark):
    n, e = nodes(spark, NODE_ROWS), edges(spark, EDGE_ROWS)
    a = scope.scope_conversation(n, e, A)
    assert {r.id for r in a.nodes.collect()} == {"mill", "weir", "lock", "d1", "cat1", "maker"}
    assert a.claim.first().asDict() == {"tagged": 3, "by_edge": 0, "by_entity": 1, "untagged_decisions": 2, "untagged": 1, "total_semantic": 5}
    s = scope.summarise(a.nodes, a.edges).first()
    assert (s.entities, s.decisions, s.relations) == (3, 1, 2)
    b = scope.scope_conversation(n, e, B)
    ids = {r.id for r in b.nodes.collect()}
    assert {"dyke", "lock"} <= ids and b.claim.first().by_edge == 1
    assert all(r.source_id in ids and r.target_id in ids for r in b.edges.collect())
    assert scope.scope_conversation(n, e, "").nodes.count() == 0


def test_taken_tag(spark):
    stolen = [(i, t, s, [B] if i == "lock" else tags) for i, t, s, tags in NODE_ROWS]
    a = scope.scope_conversation(nodes(spark, stolen), edges(spark, EDGE_ROWS), A)
    assert "lock" in {r.id for r in a.nodes.collect()} and a.claim.first().by_edge == 1


def test_all_and_own(spark):
    n, e = nodes(spark, NODE_ROWS), edges(spark, EDGE_ROWS + [("mill", "nowhere", "uses", None), ("mill", "lock", "uses", None), ("mill", "mill", "uses", None)])
    assert scope.scope_all(n, e).nodes.count() == 10
    assert scope.scope_all(n, e).claim.first().asDict() == {"tagged": 4, "by_edge": 0, "by_entity": 0, "untagged": 1, "total_semantic": 5}
    own = scope.scope_own(n, e).claim.first()
    assert (own.tagged, own.total_semantic, own.dropped_edges) == (5, 5, 4)


def test_chained_decisions_follow_node_order(spark):
    n = nodes(spark, [("e", "ORG", None, [A]), ("d1", "decision", None, None), ("d2", "decision", None, None), ("d0", "decision", None, None), ("late", "decision", None, None)])
    e = edges(spark, [("d1", "e", "involves", None), ("d2", "d1", "involves", None), ("d0", "d2", "involves", None), ("d1", "late", "involves", None), ("late", "late", "involves", None)])
    assert rows(scope.claimed_decisions(n, e, n.where("id = 'e'").select("id"))) == [("d0",), ("d1",), ("d2",)]
    turned = nodes(spark, [("e", "ORG", None, [A]), ("d2", "decision", None, None), ("d1", "decision", None, None)])
    assert rows(scope.claimed_decisions(turned, e, n.where("id = 'e'").select("id"))) == [("d1",)]


def test_satellites_follow_edge_order(spark):
    n = nodes(spark, [("e", "ORG", None, [A]), ("c1", "category", None, None), ("c2", "decision_maker", None, None), ("c3", "decision", None, None), ("c4", "category", None, None)])
    e = edges(spark, [("c1", "c4", "x", None), ("e", "c1", "x", None), ("c1", "c2", "x", None), ("c2", "c3", "x", None)])
    assert rows(scope.claimed_satellites(n, e, n.where("id = 'e'").select("id"))) == [("c1",), ("c2",), ("c3",)]


def test_types(spark):
    n = nodes(spark, [("a", "B", None, None), ("b", "A", None, None), ("c", None, None, None), ("d", "A", None, None), ("e", "B", None, None)])
    assert [tuple(r) for r in scope.by_type(n).collect()] == [("B", 2), ("A", 2), ("Unknown", 1)]
