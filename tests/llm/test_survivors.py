"""Survivors by the rules, and branch and bound against all choices."""

import json
import random
from itertools import product

from pyspark.sql import functions as F

from quernel.llm.survivors import best_bundles, consistent_bundles, counted_metadata, dependent_bundles, filled_fields, known, node_bundles, opened, winners, with_parts, with_trust
from tests.conftest import at, rows

NODES = "pos bigint, id string, type string, label string, metadata string, writer string, written_at timestamp_ntz, trust string, rows string, part string"
W = "writer string, trust int"
WRITERS = [("good", 5), ("good", 2), ("poor", 1), ("same", 5), (None, 9), ("zero", None)]


def frame(spark, nodes):
    return with_trust(spark.createDataFrame([(p, i, t, la, m, w, at(d), "x", "x", "x") for p, i, t, la, m, w, d in nodes], NODES), spark.createDataFrame(WRITERS, W))


def won(spark, nodes):
    return rows(winners(best_bundles(counted_metadata(frame(spark, nodes)), node_bundles()), ["type", "label", "metadata"]))


D1, D2 = "2025-01-01 00:00:00", "2025-01-02 00:00:00"


def test_rules(spark):
    nodes = [
        (1, "a", "ORG", "old", '{"a": 1, "b": "x"}', "good", D1), (2, "a", "N/A", "new", '{"a": 1, "b": " ", "c": [], "d": {}, "e": null}', "good", D2), (3, "a", "City", " ", "{broken", "poor", D2),
        (4, "b", " ", None, None, None, None), (5, "b", "?", None, '"text"', "good", D1), (6, "c", "ORG", "one", None, "good", D1),
        (7, "d", "A", "x", '"{\\"a\\": 1, \\"b\\": 2}"', "none", D1), (8, "d", "B", "y", '{"a": "[]", "b": 1}', "good", D1), (9, "d", "C", "z", '{"a": 1}', "same", D1), (9, "d", "C", "z", '{"a": 1}', "same", D1), (10, None, "A", "x", "{}", "good", D1), (11, None, "A", "x", "{}", "good", D1),
        (12, "e", "A", "x", None, "good", None), (13, "e", "B", "x", None, "good", D1), (14, "e", "C", "x", None, "zero", D2),
    ]
    assert won(spark, nodes) == sorted([("a", "type", 1), ("a", "label", 2), ("a", "metadata", 1), ("d", "type", 9), ("d", "label", 9), ("d", "metadata", 7), ("e", "type", 13), ("e", "label", 14)], key=repr)
    assert won(spark, []) == []


def test_texts(spark):
    df = spark.createDataFrame([(" Unknown ",), ("-",), ("　",), (None,), ("decision_maker",), ("x" * 100_000,)], "t string")
    assert [r[0] for r in df.select(known(df.t)).collect()] == [False, False, False, False, True, True]
    df = spark.createDataFrame([('{"a": "{}", "b": "[ ]", "c": "　", "d": 0, "e": false}',), ('[{"a": 1}]',), (None,), ("",), ('"\\"{}\\""',), ('{"a": "' + "x" * 1_000_000 + '"}',)], "t string")
    assert [r[0] for r in df.select(filled_fields(df.t)).collect()] == [2, 0, 0, 0, 0, 1]


def test_branch_and_bound(spark):
    rnd = random.Random(5)
    nodes = [(k, f"g{k % 12}", rnd.choice(["A", "B", "C", None, "?"]), rnd.choice(["x", "y", "z", ""]), None, rnd.choice(["good", "poor", "zero"]), D1) for k in range(90)]
    trust = {"good": 5, "poor": 1, "zero": 0}
    best = best_bundles(frame(spark, nodes), consistent_bundles(), (("type", "label"),)).collect()
    assert len(best) == 12
    for r in best:
        own = {n[0]: n for n in nodes if n[1] == r.id}
        t = lambda n: n[2] if n[2] not in (None, "?") else None
        la = lambda n: n[3] or None
        top = lambda f, v: max((trust[n[5]] for n in own.values() if f(n) == v), default=0)
        stands = {(t(n), la(n)) for n in own.values()}
        types, labels = {t(n) for n in own.values()} - {None} or {None}, {la(n) for n in own.values()} - {None} or {None}
        worth = lambda a, b: (a is not None) * (top(t, a) + 1e9) + (b is not None) * (top(la, b) + 1e9)
        total = max(worth(a, b) for a, b in product(types | {None}, labels | {None}) if a is None or b is None or (a, b) in stands)
        a, b = own[r.type] if r.type is not None else None, own[r.label] if r.label is not None else None
        assert worth(a and t(a), b and la(b)) == total and (a is None or trust[a[5]] == top(t, t(a))) and (b is None or trust[b[5]] == top(la, la(b)))
        assert a is None or b is None or (t(a), la(b)) in stands


def test_unusable_values_give_no_bound(spark):
    nodes = [(1, "a", "T", "L", None, "poor", D1), (2, "a", "?", "M", None, "good", D2), (3, "a", "T", "N", None, "zero", D2)]
    assert rows(best_bundles(frame(spark, nodes), consistent_bundles(), (("type", "label"),)).drop("branches")) == [("a", 3, 1, 1)]


def test_no_pair_at_all(spark):
    nodes = [(1, "a", "T", None, None, "poor", D1), (2, "a", "?", "M", None, "good", D2)]
    assert rows(best_bundles(frame(spark, nodes), consistent_bundles(), (("type", "label"),)).drop("branches")) == [("a", 2, None, 2)]


def test_root_is_kept_where_it_fits(spark):
    nodes = [(1, "a", "T", "L", None, "good", D1), (2, "a", "T", "M", None, "poor", D2)]
    assert rows(best_bundles(frame(spark, nodes), consistent_bundles(), (("type", "label"),)).drop("branches")) == [("a", 2, 1, 1)]


def test_bundles_of_several_fields(spark):
    rnd = random.Random(9)
    meta = lambda: json.dumps({"user_city": rnd.choice(["c", "d", "", None]), "note": rnd.choice(["n", None]), "extraction": {"model": rnd.choice(["m", "k", ""]), "passes": [rnd.randint(0, 1)]}})
    nodes = [(k, f"g{k % 25}", rnd.choice(["A", "B", "?"]), rnd.choice(["x", "y", ""]), meta(), rnd.choice(["good", "poor", "zero"]), D1) for k in range(150)]
    trust = {"good": 5, "poor": 1, "zero": 0}
    best = best_bundles(with_parts(frame(spark, nodes)), *dependent_bundles()).collect()

    def values(n):
        m = json.loads(n[4])
        place = (m["user_city"], m["note"])
        return (n[2], n[3]) if n[2] != "?" and n[3] else None, place if any(place) else None, (m["extraction"]["model"], str(m["extraction"]["passes"])) if m["extraction"]["model"] else None

    for r in best:
        own = {n[0]: values(n) for n in nodes if n[1] == r.id}
        top = lambda k, v: max(trust[nodes[p][5]] for p, x in own.items() if x[k] == v)
        options = [{x[k] for x in own.values()} | {None} for k in range(3)]
        stands = lambda k, a, b: a is None or b is None or any(x[0] == a and x[k] == b for x in own.values())
        worth = lambda c: sum(top(k, v) + 1e9 for k, v in enumerate(c) if v is not None)
        want = max(worth(c) for c in product(*options) if stands(1, c[0], c[1]) and stands(2, c[0], c[2]))
        got = [own[p][k] if p is not None else None for k, p in enumerate((r.name, r.place, r.extraction))]
        assert worth(got) == want and stands(1, got[0], got[1]) and stands(2, got[0], got[2])
        assert all(p is None or trust[nodes[p][5]] == top(k, got[k]) for k, p in enumerate((r.name, r.place, r.extraction)))
    assert 0 < sum(r.branches > 0 for r in best) < 25


def test_hot_group_under_one_type(spark):
    """One id with as many labels as rows, all of one type, whose best label stands beside another type: branched, in no task whole."""
    hot = spark.range(200_000).select(F.col("id").alias("pos"), F.lit("a").alias("id"), F.lit("T").alias("type"), F.concat(F.lit("l"), F.col("id")).alias("label"), F.lit(None).cast("string").alias("metadata"), F.lit("poor").alias("writer"), F.lit(D1).cast("timestamp_ntz").alias("written_at"))
    odd = spark.createDataFrame([(300_000, "a", "?", "odd", None, "good", at(D2)), (300_001, "a", "U", "last", None, "poor", at(D1))], hot.schema)
    rows_ = with_trust(hot.unionByName(odd), spark.createDataFrame(WRITERS, W))
    assert rows(best_bundles(rows_, consistent_bundles(), (("type", "label"),))) == [("a", 200_002, 300_001, 300_001, 2)]


def test_opened_often(spark):
    text = '{"a": 1, "b": [2]}'
    cases = [text]
    for _ in range(6):
        cases.append(json.dumps(cases[-1]))
    df = spark.createDataFrame([(c,) for c in [*cases, None, '"x"', "[1]"]], "t string")
    assert [tuple(r) for r in df.select(filled_fields("t"), opened("t")).collect()] == [(2, text)] * 7 + [(0, None)] * 3
