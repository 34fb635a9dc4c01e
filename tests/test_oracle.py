"""Registered queries against their SQL. A spread of them by default, all of them with SPANWEAVE_ORACLE=all."""

import os

import pytest
from oracle import compare, connect

from workload.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SPREAD = ("subtitle_findings", "coverage_ms", "nearest_finding", "scene_findings", "merge_reanalysis", "apply_edits", "status_for_paths", "library_view",
          "queue_rank", "schedule_allowed", "scan_timelines", "stream_decile_alerts", "stream_merge_hits", "peaks")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no benchmark tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("SPANWEAVE_ORACLE") == "all" else SPREAD)
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) == ""


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
