"""Graph algorithms against plain models on random graphs."""

import random

import numpy as np
import pytest

from quernel.operators import graph
from quernel.operators.scope import clean_edges, summarise
from quernel.plans import core_queries, tables
from tests.conftest import rows

NODES = "pos bigint, id string, type string, label string, status string, tags array<string>"
EDGES = "pos bigint, source_id string, target_id string, type string, weight double, tags array<string>"


def frames(spark, n, pairs, kinds=("ORG",)):
    nodes = spark.createDataFrame([(k * 3, f"n{k}", kinds[k % len(kinds)], f"L{k % 4}", None, None) for k in range(n)], NODES)
    edges = spark.createDataFrame([(k, f"n{a}", f"n{b}", t, None, None) for k, (a, b, t) in enumerate(pairs)], EDGES)
    return nodes, clean_edges(edges, nodes)


def drawn(seed, n=40, m=60):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), rnd.choice("ab")) for _ in range(m)]


def kept(pairs):
    return {(a, b, t) for a, b, t in pairs if a != b}


def test_components(spark):
    chain = [(k, k + 1, "a") for k in range(30)] + [(40, 39, "a"), (38, 40, "b")]
    for pairs in (chain, drawn(1, 45, 30)):
        nodes, edges = frames(spark, 45, pairs)
        parent = list(range(45))
        for _ in range(45):
            for a, b, _t in kept(pairs):
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert rows(graph.components(nodes, edges)) == sorted(((k * 3, parent[k] * 3) for k in range(45)), key=repr)
        sizes = {}
        for p in parent:
            sizes[p] = sizes.get(p, 0) + 1
        assert sorted(r[1] for r in graph.component_sizes(nodes, edges).collect()) == sorted(sizes.values())


def test_pagerank(spark):
    pairs = drawn(2)
    nodes, edges = frames(spark, 40, pairs)
    out = [[b for a, b, _ in kept(pairs) if a == k] for k in range(40)]
    rank = np.full(40, 1 / 40)
    for _ in range(20):
        new = np.full(40, 0.15 / 40 + 0.85 * sum(rank[k] for k in range(40) if not out[k]) / 40)
        for k in range(40):
            for b in out[k]:
                new[b] += 0.85 * rank[k] / len(out[k])
        rank = new
    got = {r.pos // 3: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert np.allclose([got[k] for k in range(40)], rank, atol=1e-12) and sum(got.values()) == pytest.approx(1)


def labels(n, pairs, sweeps=10):
    around = [set() for _ in range(n)]
    for a, b, _ in kept(pairs):
        around[a].add(b)
        around[b].add(a)
    label = list(range(n))
    for _ in range(sweeps):
        before = list(label)
        for i in range(n):
            votes = {}
            for j in around[i]:
                votes[label[j]] = votes.get(label[j], 0) + 1
            best, most = label[i], votes.get(label[i], 0)
            for x in sorted(votes):
                if votes[x] > most:
                    best, most = x, votes[x]
            label[i] = best
        if before == label:
            break
    return label


def test_sweep_in_plain_arrays():
    for seed in range(60):
        pairs = drawn(seed, 25, 45)
        links = sorted({(a, b) for a, b, _ in kept(pairs)} | {(b, a) for a, b, _ in kept(pairs)})
        ids, got = graph.sweep(*np.array(links).T)
        want = labels(25, pairs)
        assert dict(zip(ids.tolist(), got.tolist(), strict=True)) == {i: want[i] for i in ids}


def test_communities_in_one_task_and_as_a_wave(spark):
    pairs = drawn(5, 24, 34)
    nodes, edges = frames(spark, 24, pairs, ("ORG", "decision"))
    want = sorted(((k * 3, x * 3) for k, x in enumerate(labels(24, pairs))), key=repr)
    assert rows(graph.communities(nodes, edges)) == want
    assert rows(graph.communities(nodes, edges, one_task=0)) == want
    largest, members = graph.community_list(nodes, edges)
    sizes = sorted((n for n in {x: [y for _, y in want].count(x) for _, x in want}.values() if n > 1), reverse=True)
    assert [r.size for r in largest.orderBy("size", ascending=False).collect()] == sizes[:12]
    assert members.where("type = 'decision'").count() == 0


def test_communities_by_blocks(spark, monkeypatch):
    """Rounds follow the blocks, not the longest chain of the order."""
    rounds, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (rounds.append(name), write(df, name))[1])
    path = [(k, k + 1, "a") for k in range(59)]
    for n, pairs, most in ((60, path, 20), (60, path[::-1] + [(0, 59, "a"), (3, 59, "b")], 20), (40, drawn(7, 40, 70), 50)):
        rounds.clear()
        nodes, edges = frames(spark, n, pairs)
        assert rows(graph.communities(nodes, edges, one_task=45)) == sorted(((k * 3, x * 3) for k, x in enumerate(labels(n, pairs))), key=repr)
        assert 3 <= len(rounds) <= most


def test_blocks_are_smaller_than_what_one_task_sweeps(spark, monkeypatch):
    """An executor holds a block for each core, the one task alone; rounds don't have four tasks for each of many blocks."""
    made, write = {}, graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: made.setdefault(name, []).append(write(df, name)) or made[name][-1])
    pairs = [(k, k + 1, "a") for k in range(79)]
    nodes, edges = frames(spark, 80, pairs)
    assert rows(graph.communities(nodes, edges, one_task=100, block=5)) == sorted(((k * 3, x * 3) for k, x in enumerate(labels(80, pairs))), key=repr)
    sizes = [r[0] for r in made["blocks"][0].selectExpr("octet_length(to) div 4").collect()]
    assert len(sizes) >= 24 and max(sizes) <= 5 + 2 and sum(sizes) == 2 * 79


def test_overview_numbers_links_once(spark, monkeypatch):
    calls, number = [], graph.numbered
    monkeypatch.setattr(graph, "numbered", lambda *x: (calls.append(1), number(*x))[1])
    nodes, edges = frames(spark, 6, [(0, 1, "a"), (1, 2, "a"), (3, 4, "b"), (0, 2, "a")])
    monkeypatch.setattr(core_queries, "_clean", lambda *_: tables.Graph(nodes, edges))
    got = core_queries.overview(spark, "").first()
    assert (got.components, got.largest_component, got.isolated, got.communities, got.nodes, got.edges) == (3, 3, 1, 2, 6, 4) and len(calls) == 1


def test_community_list_numbers_links_once(spark, monkeypatch):
    calls, number = [], graph.numbered
    monkeypatch.setattr(graph, "numbered", lambda *x: (calls.append(1), number(*x))[1])
    nodes, edges = frames(spark, 5, [(0, 1, "a"), (1, 2, "a"), (3, 4, "b"), (0, 2, "a")])
    largest, members = graph.community_list(nodes, edges)
    assert rows(largest) == [(12, 2), (3, 3)] and len(calls) == 1
    assert rows(members.select("community", "place", "id", "degree")) == [(12, 1, "n3", 1), (12, 2, "n4", 1), (3, 1, "n0", 2), (3, 2, "n1", 2), (3, 3, "n2", 2)]


def test_degrees(spark):
    pairs = [(0, 1, "a"), (0, 1, "b"), (1, 0, "a"), (2, 2, "a"), (3, 0, "a"), (0, 1, "a")]
    nodes, edges = frames(spark, 5, pairs)
    assert rows(graph.degrees(nodes, edges).select("id", "degree")) == [("n0", 2), ("n1", 1), ("n2", 0), ("n3", 1), ("n4", 0)]
    assert rows(graph.out_degrees(nodes, edges)) == [("n0", 2), ("n1", 1), ("n3", 1)]
    assert rows(graph.isolated(nodes, edges)) == [("n2",), ("n4",)]
    assert rows(summarise(nodes, edges)) == [(5, 4, 5, 4, 0)]
    hubs = graph.hubs(graph.degrees(nodes, edges), "degree").collect()
    assert [(h.id, h.degree) for h in hubs][:3] == [("n0", 2), ("n1", 1), ("n3", 1)]


def test_repeated_ids_and_no_nodes(spark):
    nodes = spark.createDataFrame([(0, "a", None, "a", None, None), (1, "b", "ORG", "b", None, None), (2, "a", "ORG", "a", None, None)], NODES)
    edges = clean_edges(spark.createDataFrame([(0, "a", "b", None, None, None), (1, "a", "b", None, 3.0, None)], EDGES), nodes)
    assert rows(edges) == [(0, "a", "b", None, 1.0)]
    assert rows(graph.components(nodes, edges)) == [(0, 0), (1, 1), (2, 1)]  # edges go to the last node of an id
    none = (nodes.limit(0), edges.limit(0))
    assert graph.pagerank(*none).count() == graph.components(*none).count() == graph.communities(*none).count() == 0
