"""What the physical plans must and must not hold."""

import re

import pytest

from repolume.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", text))


@pytest.mark.parametrize(
    "name",
    ["trending_repositories", "top_contributors", "repo_activity_ranking", "top_labels", "sample_repos"],
)
def test_top_k_is_taken_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize(
    "name", ["top_contributors_by_repo", "daily_activity", "flaky_tests", "dedup_events"]
)
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


@pytest.mark.parametrize("name", ["trending_repositories", "detailed_analytics", "lead_time_hours"])
def test_look_back_reaches_the_scan(spark, name):
    assert "GreaterThanOrEqual(ts," in plan(spark, name)


@pytest.mark.parametrize(
    "name", ["system_health", "daily_anomalies", "community_health", "repository_profile",
             "data_diagnostics", "metric_bands", "detailed_analytics_nested"]
)
def test_events_are_scanned_once_per_role(spark, name):
    # the issue table is itself joined from events, as is the forecast stand-in
    joined = {"system_health": 1, "metric_bands": 1, "data_diagnostics": 2}.get(name, 0)
    assert scans(plan(spark, name), "events") == 1 + joined


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "event_traffic_daily")
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_no_cross_joins(spark):
    for name in QUERIES:
        text = plan(spark, name)
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


@pytest.mark.parametrize("name", ["issues_by_state", "open_issues", "mttr_hours", "issues_created_daily"])
def test_labels_are_read_only_where_asked_for(spark, name):
    assert scans(plan(spark, name), "labels") == 0
    assert scans(plan(spark, "top_labels"), "labels") == 1


@pytest.mark.parametrize(
    "name", ["event_traffic_from_rollup", "daily_activity_from_rollup", "forecast_repos_from_rollup"]
)
def test_rollup_readers_do_not_scan_events(spark, name):
    assert scans(plan(spark, name), "events") == 0
