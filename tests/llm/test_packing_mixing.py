"""Packing and mixing: whole, within capacity, near the best; rates and caps."""

import random
from pathlib import Path

import pytest

from quernel.llm import mixing, packing
from quernel.llm.mixing import mix, plan, rates, shares
from quernel.llm.packing import best_fit, fill_report, pack, reduce_instance, solve
from quernel.llm.tokens import TOKENIZER, encoder, token_sizes
from tests.conftest import rows

SIZES = "doc_id bigint, tokens bigint, bin string, container string, piece string, salt string, rate double, source string"


def least_bins(capacity, items):
    """The optimum by search, for a few items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_is_no_loss():
    rnd = random.Random(1)
    triples = 0
    for _ in range(1500):
        capacity = rnd.randint(5, 40)
        items = [rnd.randint(rnd.choice([1, 1 + capacity // 6]), capacity) for _ in range(rnd.randint(0, 9))]
        left = {s: items.count(s) for s in items}
        fixed = reduce_instance(capacity, left)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert all(sum(s * k for s, k in p) <= capacity for _, p in fixed)
        triples += sum(sum(k for _, k in p) == 3 for _, p in fixed)
        assert sum(n for n, _ in fixed) + least_bins(capacity, rest) == least_bins(capacity, items)
    assert triples > 50


def test_solve_stays_within_capacity():
    rnd = random.Random(2)
    for capacity in (10, 512):
        h = {s: rnd.randint(1, 400) for s in rnd.sample(range(1, capacity + 1), 9)}
        got = best_fit(capacity, dict(h))
        assert all(sum(s * k for s, k in p) <= capacity for _, p in got)
        assert {s: sum(n * k for n, p in got for t, k in p if t == s) for s in h} == h
        assert solve(capacity, h).containers <= 1.25 * -(-sum(s * n for s, n in h.items()) // capacity) + 1


def frame(spark, sizes):
    return spark.createDataFrame([(k, n, "x", "x", "x", "x", 9.0, "s") for k, n in sizes], SIZES)


def kinds(spark, *caps):
    return spark.createDataFrame([(f"k{c}", c) for c in caps] + [("none", None), (None, 5)], "container string, capacity_tokens int")


def test_pack(spark):
    rnd = random.Random(4)
    sizes = [(k, rnd.choice([0, 1, 3, 3, 3, 7, 10, 11, 25, 1000])) for k in range(500)] + [(1000, 3), (1000, 3)]
    out, plans = pack(frame(spark, sizes), kinds(spark, 10, 16))
    got = out.collect()
    for c in (10, 16):
        own = [r for r in got if r.container == f"k{c}"]
        assert sum(r.tokens for r in own) == sum(n for _, n in sizes) and {r.doc_id for r in own} == {k for k, _ in sizes}
        load = {}
        for r in own:
            assert (r.bin is None) == (r.tokens == 0) and r.start == r.piece * c
            load[r.bin] = load.get(r.bin, 0) + r.tokens
        load.pop(None)
        assert max(load.values()) <= c and sorted(load) == list(range(plans[f"k{c}"].containers))
        cut = {r.doc_id for r in own if r.piece > 0}
        assert cut == {k for k, n in sizes if n > c}
    report = {r.container: r for r in fill_report(out).collect()}
    assert report["k10"].bins == plans["k10"].containers and report["k10"].least_bins <= report["k10"].bins


def test_pack_nothing(spark):
    assert pack(frame(spark, []), kinds(spark, 10))[0].count() == 0
    assert pack(frame(spark, [(1, 5)]), kinds(spark))[0].count() == 0
    assert rows(pack(frame(spark, [(1, 0)]), kinds(spark, 10))[0]) == [(1, "k10", 10, 0, 0, 0, None)]


def test_rates():
    got = rates({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "gone": (0.1, 1)}, {"a": 1000, "b": 100, "c": 500})
    total = sum(x.rate * x.tokens for x in got.values())
    assert got["b"].rate == pytest.approx(2) and all(x.rate <= x.cap + 1e-9 for x in got.values())
    assert got["a"].rate * 1000 / total == pytest.approx(0.5) and got["c"].rate * 500 / total == pytest.approx(0.2)
    more = rates({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 1000, "b": 100}, 1000)
    assert more["b"].rate == 2 and more["a"].rate == pytest.approx(0.8)
    assert all(x.rate == x.cap for x in rates({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 10, "b": 10}, 10**9).values())
    kept = rates({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 1000, "b": 10})  # shares are held, however small the mixture
    assert kept["b"].rate == 2 and kept["a"].rate == pytest.approx(0.02)
    scarce = rates({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 1000, "b": 1}, least_part=0.25)
    assert scarce["b"].rate == 2 and scarce["a"].rate == pytest.approx((1001 / 4 - 2) / 1000)
    assert rates({}, {"a": 1}) == {} and rates({"a": (1.0, 1)}, {}) == {}


def test_mix(spark):
    docs = [(k, 100, "x", "x", "x", "x", 9.0, s) for k, s in enumerate(["big"] * 3000 + ["small"] * 300 + [None] * 5 + ["other"] * 5)]
    sizes = spark.createDataFrame(docs, SIZES)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    asked, sources = plan(sizes, targets)
    got = mix(sizes, sources)
    assert rows(got) == rows(mix(sizes.repartition(7), sources))
    r = {x.source: x for x in shares(got, asked, sources).collect()}
    assert r["small"].most_repeats == 3 and r["small"].copies == 900 and r["big"].most_repeats == 1 and r["gone"].copies == 0
    assert abs(r["big"].actual_share - 0.5 / 0.9) < 0.02
    none = plan(sizes.limit(0), targets)
    assert mix(sizes.limit(0), none[1]).count() == 0 and shares(mix(sizes.limit(0), none[1]), *none).count() == 3


def test_nothing_is_dropped_beyond_the_most(spark, monkeypatch):
    sizes = spark.createDataFrame([(k, 10, "x", "x", "x", "x", 9.0, f"s{k}") for k in range(3)], SIZES)
    targets = spark.createDataFrame([(f"s{k}", 0.3, 1) for k in range(3)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(packing, "MOST_CONTAINERS", 2)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        pack(sizes, kinds(spark, 10, 16, 20))
    with pytest.raises(ValueError, match="more than 2"):
        plan(sizes, targets)
    assert pack(sizes, kinds(spark, 10, 16))[0].count() == 6 and len(plan(sizes, targets.limit(2))[1]) == 2


def test_scarce_source_keeps_its_share(spark):
    sizes = spark.createDataFrame([(k, 10, "x", "x", "x", "x", 9.0, "scarce" if k < 40 else "big") for k in range(4040)], SIZES)
    targets = spark.createDataFrame([("big", 0.5, 1), ("scarce", 0.5, 2)], "source string, target_share double, max_repeats int")
    asked, sources = plan(sizes, targets)
    assert {s: x.rate * x.tokens for s, x in sources.items()} == pytest.approx({"big": 800, "scarce": 800})
    r = {x.source: x for x in shares(mix(sizes, sources), asked, sources).collect()}
    assert r["scarce"].copies == 80 and abs(r["scarce"].actual_share - 0.5) < 0.1
    floor = plan(sizes, targets, least_part=0.25)[1]
    assert sum(x.rate * x.tokens for x in floor.values()) == pytest.approx(0.25 * 40_400) and floor["scarce"].rate == 2


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer file")
def test_tokens(spark):
    texts = [None, "", " \n", "hello <|endoftext|> 中文 ß", "a" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [n for _, n in rows(token_sizes(df, ["doc_id"], "text"))]
    assert got[:2] == [0, 0] and got[2] > 0 and got[4] > 1000
    assert encoder().decode(encoder().encode_ordinary(texts[3])) == texts[3] and got[3] == len(encoder().encode_ordinary(texts[3]))
