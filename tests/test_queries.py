"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from quernel.plans.core_queries import QUERIES
from quernel.plans.oracles import ORACLES
from tests.check_sql import SF, differs

NAMES = [
    "p3_found", "p3_report", "p6_found", "p6_tables", "clean_edges", "scope_conversation", "claim_conversation", "graph_summary", "degree", "hubs_by_degree", "connected_components",
    "hubs_by_rank", "decision_list", "decision_entities", "write_route", "replay_nodes", "node_tags", "edge_tags", "toggle_migrate", "source_resolution",
]


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, name):
    assert differs(spark, QUERIES[name], ORACLES[name]) is None
