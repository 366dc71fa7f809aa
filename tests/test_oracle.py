"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

from check_oracle import compare
from workloads import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLED = (
    "plan_join_group_having plan_count filter_tree theta_join merge_outer cohort_stats grouped_stats_large_groups "
    "box_stats_large_groups box_stats_midpoint_rule kaplan_meier_large_groups kaplan_meier_median_split facet_sweep "
    "latest_version file_history_large_groups file_children registry_page link_resolution register_files upsert_tags "
    "registry_unflatten similarity_topk dictionary matrix_long bundle_completeness"
).split()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", SAMPLED)
def test_agrees_with_sql(spark, name):
    result, _ = compare(spark, SF, name)
    assert result.startswith("ok"), result
