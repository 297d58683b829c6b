"""Pairs against counting every pair of every basket."""

import random
from collections import Counter
from itertools import combinations

import pytest

from quernel.llm import pairs
from quernel.llm.pairs import Thresholds, conversation_baskets, decision_baskets, frequent_pairs
from tests.conftest import rows


def brute(members, limits):
    baskets = {}
    for b, i in members:
        baskets.setdefault(b, set()).add(i)
    n, single, both = len(baskets), Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    return sorted((a, b, c, single[a], single[b], n) for (a, b), c in both.items() if c >= limits.least and c * limits.part >= n and c * n >= limits.lift * single[a] * single[b])


def found(spark, members, limits):
    df = spark.createDataFrame(list(members), "basket string, item string")
    return rows(frequent_pairs(df, limits).select("id_a", "id_b", "together", "count_a", "count_b", "baskets"))


@pytest.mark.parametrize("large", [3, 400])
def test_model(spark, monkeypatch, large):
    monkeypatch.setattr(pairs, "LARGE", large)
    rnd = random.Random(large)
    groups = [[f"i{g}{k}" for k in range(5)] for g in range(6)]
    members = set()
    for b in range(60):
        for i in rnd.sample(rnd.choice(groups), 3) + rnd.choice(groups)[: rnd.randint(0, 2)]:
            members.add((f"b{b}", i))
    members |= {(f"hot{h}", i) for h in range(3) for g in groups for i in g}  # baskets with everything
    for limits in (Thresholds(3, 2000, 2), Thresholds(2, 2000, 1), Thresholds(5, 20, 3)):
        assert found(spark, members, limits) == sorted(brute(members, limits), key=repr)


def test_more_large_baskets_than_may_be_joined(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LARGE", 2)
    monkeypatch.setattr(pairs, "MOST_JOINED", 1)
    members = {(f"b{b}", f"i{k}") for b in range(12) for k in range(b % 4, b % 4 + 7)} | {(f"e{k}", "x") for k in range(20)}
    limits = Thresholds(3, 2000, 1)
    assert found(spark, members, limits) == sorted(brute(members, limits), key=repr)


def test_nothing(spark):
    assert found(spark, [], Thresholds()) == []
    assert found(spark, [("b", "x")], Thresholds(1, 2000, 1)) == []


def test_baskets(spark):
    d = spark.createDataFrame([("d", ["a ", "　a", "", " ", None, "b"], "x"), ("d", ["c"], "x"), ("e", None, "x"), ("f", [], "x"), (None, ["a"], "x"), ("g", ["y" * 100_000], "x")], "id string, entities array<string>, item string")
    assert rows(decision_baskets(d)) == sorted([("d", "a"), ("d", "b"), ("d", "c"), ("g", "y" * 100_000)])
    n = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", '["s", "t", " ", "t"]'), ("c", ""), ("d", None), (None, "s"), ("e", "[broken"), ("", " s")], "id string, conversation string")
    assert rows(conversation_baskets(n)) == sorted([("s", "a"), ("s", "b"), ("t", "b"), ("[broken", "e"), (" s", "")], key=repr)
