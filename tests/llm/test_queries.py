"""Registered queries against their SQL on the smallest tables, and what the others promise."""

from pathlib import Path

import pytest

from quernel.llm.oracles import ORACLES
from quernel.llm.pairs import Thresholds, conversation_baskets
from quernel.llm.queries import QUERIES
from quernel.session import read
from tests.check_sql import SF, differs
from tests.llm.test_pairs import brute

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert differs(spark, QUERIES[name], ORACLES[name]) is None


def test_conversation_pairs(spark):
    members = conversation_baskets(read(spark, SF, "kg_nodes")).collect()
    want = {(a, b): (c, na, nb, n, round(c * n / (na * nb), 6)) for a, b, c, na, nb, n in brute([tuple(r) for r in members], Thresholds())}
    got = QUERIES["p1_conversation_pairs"](spark, SF).collect()
    assert {(r.id_a, r.id_b): (r.together, r.count_a, r.count_b, r.baskets, pytest.approx(r.lift)) for r in got} == want and len(got) == len(want)
    for r in got:
        rest = 1 - r.together / r.count_a
        assert r.conviction == (pytest.approx((1 - r.count_b / r.baskets) / rest, abs=1e-5) if rest else None)
    assert {(r.id_a, r.id_b) for r in got} == {(r.id_a, r.id_b) for r in QUERIES["p1_found"](spark, SF).where("basket = 'conversation'").collect()}


def test_packed(spark):
    packed = QUERIES["p7_packed"](spark, SF).collect()
    load = {}
    for r in packed:
        if r.bin is not None:
            load[r.container, r.bin] = load.get((r.container, r.bin), 0) + r.tokens
    capacity = {r.container: r.capacity for r in packed}
    assert all(n <= capacity[k] for (k, _), n in load.items())
    assert all(r.bins <= 1.05 * r.least_bins + 1 for r in QUERIES["p7_fill"](spark, SF).collect())


def test_shares(spark):
    got = QUERIES["p8_shares"](spark, SF).collect()
    assert sum(r.actual_share for r in got) == pytest.approx(1) and all(r.most_repeats <= r.max_repeats for r in got)


def test_levels(spark):
    profile = QUERIES["p9_profile"](spark, SF).collect()
    found = QUERIES["p9_found"](spark, SF).count()
    assert sum(r.level_4 + r.level_5 for r in profile) == found > 0
