from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolume.operators import anomalies, ci, contributors, delivery, issues, repositories, traffic
from repolume.plans import tables as t
from repolume.sources.thresholds import DEFAULTS

SF_DIR = "/root/testdata/sf0.001"
AS_OF = t.AS_OF
EVENTS = (
    "id string, type string, actor_login string, repo_name string, created_at timestamp, "
    "payload string, org_login string"
)
ISSUES = (
    "id bigint, number bigint, title string, body string, labels array<string>, state string, "
    "created_at timestamp, closed_at timestamp, user_login string, repo_name string"
)


def make_events(spark, *rows):
    """Rows of (type, actor, repo, time, payload)."""
    return spark.createDataFrame(
        [
            (str(i), kind, actor, repo, datetime.fromisoformat(when), payload, None)
            for i, (kind, actor, repo, when, payload) in enumerate(rows)
        ],
        EVENTS,
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def on_sf(spark):
    return t.activity(spark, SF_DIR), t.issues(spark, SF_DIR)


OPERATORS = {
    "repository_stats": lambda e, i: repositories.repository_stats(e),
    "velocity": lambda e, i: repositories.developer_velocity(e, AS_OF),
    "health": lambda e, i: repositories.community_health(e, AS_OF),
    "trending": lambda e, i: repositories.trending_repositories(e, AS_OF),
    "ranking": lambda e, i: repositories.repo_activity_ranking(e, AS_OF),
    "top": lambda e, i: contributors.top_contributors(e, AS_OF),
    "top_by_repo": lambda e, i: contributors.top_contributors_by_repo(e),
    "daily": lambda e, i: traffic.daily_activity(e),
    "hourly": lambda e, i: traffic.hourly_activity(e),
    "lead_time": lambda e, i: delivery.lead_time_hours(e, AS_OF),
    "weekly": lambda e, i: delivery.deployment_frequency_weekly(e, AS_OF),
    "cfr": lambda e, i: delivery.change_failure_rate(e, AS_OF),
    "bands": lambda e, i: delivery.metric_bands(
        e, i, AS_OF, delivery.full_steps(DEFAULTS)
    ),
    "mttr": lambda e, i: delivery.mttr_hours_exact(i),
    "labels": lambda e, i: issues.top_labels(i),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_result_does_not_depend_on_partitioning(spark, name):
    events, issue_rows = on_sf(spark)
    expected = rows(OPERATORS[name](events, issue_rows))
    for parts in (1, 7, 60):
        again = OPERATORS[name](events.repartition(parts), issue_rows.repartition(parts))
        assert rows(again) == expected


def test_type_counts_add_up_to_the_total(spark):
    events, _ = on_sf(spark)
    profile = repositories.repository_profile(events)
    sums = F.aggregate(F.map_values("event_types"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    assert profile.where(sums != F.col("total_events")).count() == 0
    stats = rows(repositories.repository_stats(events))
    assert rows(profile.drop("event_types")) == stats


def test_repository_filter_equals_filtering_the_result(spark):
    events, issue_rows = on_sf(spark)
    chosen = ["org2/repo2", "org1/repo1"]
    listed = spark.createDataFrame([(r,) for r in chosen], "repo_name string")
    whole = rows(repositories.repository_stats(events).where(F.col("repo_name").isin(chosen)))
    assert rows(repositories.repository_stats(events, chosen)) == whole
    assert rows(repositories.repository_stats(events, listed)) == whole
    by_repo = delivery.mttr_hours(issue_rows, AS_OF, by_repo=True)
    one = delivery.mttr_hours(issue_rows, AS_OF, repos=chosen[:1]).first()["mttr"]
    assert by_repo.where(F.col("repo_name") == chosen[0]).first()["mttr"] == one


def test_approximate_counts_are_near(spark):
    events, _ = on_sf(spark)
    exact = dict(rows(repositories.repository_stats(events).select("repo_name", "unique_contributors")))
    approx = dict(
        rows(repositories.repository_stats(events, approx=True).select("repo_name", "unique_contributors"))
    )
    assert all(abs(approx[r] - n) <= max(1, 0.05 * n) for r, n in exact.items())


def test_velocity_by_hand(spark):
    events = make_events(
        spark,
        *[("PushEvent", f"a{i % 2}", "o/r", f"2024-01-{20 + i % 4} 10:00:00", "{}") for i in range(10)],
        *[("PullRequestEvent", "a1", "o/r", "2024-01-20 11:00:00", "{}") for _ in range(5)],
        ("PushEvent", "old", "o/r", "2023-12-01 00:00:00", "{}"),
        ("PushEvent", "later", "o/r", "2024-03-01 00:00:00", "{}"),
    )
    row = repositories.developer_velocity(events, AS_OF).first()
    assert (row["push_events"], row["pr_events"], row["active_developers"]) == (11, 5, 3)
    assert row["active_days"] == 5 and row["events_per_day"] == 3.2
    score = 0.11 * 0.3 + 0.1 * 0.4 + 0.3 * 0.2 + 3.2 / 20 * 0.1
    assert row["velocity_score"] == round(score * 100, 2)


def test_health_by_hand(spark):
    events = make_events(
        spark,
        ("WatchEvent", "a", "o/r", "2023-01-01 00:00:00", "{}"),
        ("WatchEvent", "b", "o/r", "2024-01-30 00:00:00", "{}"),
        ("ForkEvent", "a", "o/r", "2023-01-02 00:00:00", "{}"),
        ("IssuesEvent", "c", "o/r", "2023-01-02 00:00:00", "{}"),
    )
    row = repositories.community_health(events, AS_OF).first()
    assert (row["total_events"], row["total_contributors"], row["recent_contributors"]) == (4, 3, 1)
    assert (row["stars"], row["forks"], row["total_issues"], row["total_prs"]) == (2, 1, 1, 0)
    assert row["contributor_retention_rate"] == 33.33
    total = 3 / 50 * 0.3 + 33.33 / 100 * 0.3 + 4 / 1000 * 0.2 + 3 / 100 * 0.2
    assert row["health_score"] == round(total * 100, 2)


def test_nested_analytics(spark):
    events = make_events(
        spark,
        ("PushEvent", "a", "o/r", "2024-01-20 10:00:00", "{}"),
        ("PushEvent", "b", "o/r", "2024-01-20 11:00:00", "{}"),
        ("PushEvent", "b", "o/r", "2024-01-21 11:00:00", "{}"),
        ("ForkEvent", "b", "o/r", "2024-01-21 11:00:00", "{}"),
    )
    row = repositories.detailed_analytics_nested(events, AS_OF).first()
    assert row["period_days"] == 30
    assert row["event_type_summary"] == {"ForkEvent": 1, "PushEvent": 3}
    breakdown = {
        d: {k: tuple(v) for k, v in types.items()} for d, types in row["daily_breakdown"].items()
    }
    assert breakdown == {
        "2024-01-20": {"PushEvent": (2, 2)},
        "2024-01-21": {"PushEvent": (1, 1), "ForkEvent": (1, 1)},
    }


def test_week_numbers_of_two_years_stay_apart(spark):
    payload = '{"merged":true}'
    events = make_events(
        spark,
        ("PullRequestEvent", "a", "o/r", "2023-11-06 00:00:00", payload),
        ("PullRequestEvent", "a", "o/r", "2023-12-31 00:00:00", payload),
        ("PullRequestEvent", "a", "o/r", "2024-01-01 00:00:00", '{"merged":false}'),
        ("PullRequestEvent", "a", "o/r", "2024-01-02 00:00:00", "{}"),
    )
    found = rows(delivery.deployment_frequency_weekly(events, AS_OF))
    assert [(str(d), w, n) for d, w, n in found] == [
        ("2023-11-05", 45, 1),
        ("2023-12-31", 0, 1),
        ("2023-12-31", 53, 1),
    ]


def empty(spark):
    return spark.createDataFrame([], EVENTS), spark.createDataFrame([], ISSUES)


def test_empty_tables(spark):
    events, no_issues = empty(spark)
    for name in ("repository_stats", "velocity", "health", "trending", "daily", "mttr", "labels"):
        assert OPERATORS[name](events, no_issues).count() == 0
    assert delivery.mttr_hours(no_issues, AS_OF).first()["mttr"] == 0.0
    assert delivery.mttr_hours(no_issues, AS_OF, default=None).first()["mttr"] is None
    assert delivery.change_failure_rate(events, AS_OF).first()["cfr"] == 0.0
    assert delivery.change_failure_rate(events, AS_OF, guarded=False).first()["cfr"] is None
    assert anomalies.dynamic_thresholds(events, no_issues, AS_OF).first().asDict() == DEFAULTS
    health = {r["metric"]: r for r in anomalies.system_health(events, no_issues, AS_OF).collect()}
    assert len(health) == 3 and health["Change Failure Rate"]["current"] == 0.0
    bands = {r["metric"]: r["band"] for r in OPERATORS["bands"](events, no_issues).collect()}
    assert bands == {
        "lead_time": "green", "mttr": "green", "cfr": "green", "deployments": "red",
        "open_issues": "green",
    }


def daily_counts(spark, counts, first=datetime(2024, 1, 1)):
    return make_events(
        spark,
        *[
            ("PushEvent", "a", "o/r", (first + timedelta(days=d)).isoformat(), "{}")
            for d, n in enumerate(counts)
            for _ in range(n)
        ],
    )


def test_a_day_at_the_limit_is_no_anomaly(spark):
    # ten equal days: no deviation, so the limit is the count itself
    level = anomalies.daily_anomalies(daily_counts(spark, [4] * 10), AS_OF)
    assert level.where("is_anomaly").count() == 0
    assert level.select("threshold").distinct().collect() == [(4.0,)]
    spike = anomalies.daily_anomalies(daily_counts(spark, [4] * 20 + [60]), AS_OF)
    assert [str(r["time"]) for r in spike.where("is_anomaly").collect()] == ["2024-01-21"]


def test_anomaly_line_covers_all_repositories_and_the_look_back_only(spark):
    events = daily_counts(spark, [2] * 10)
    other = events.withColumn("repo_name", F.lit("o/other"))
    old = daily_counts(spark, [50], datetime(2023, 1, 1))
    both = events.unionByName(other).unionByName(old)
    shown = anomalies.daily_anomalies(both, AS_OF, start="2024-01-03", end="2024-01-05", repos=["o/r"])
    assert [(r["events"], r["threshold"]) for r in shown.collect()] == [(2, 4.0)] * 3


def test_days_without_rows_do_not_enter_the_limit(spark):
    limits = anomalies.dynamic_thresholds(daily_counts(spark, [5, 0, 0, 5]), empty(spark)[1], AS_OF)
    assert limits.first()["events_per_day"] == 5.0


def results(spark, outcomes, test="t", workflow="build"):
    return spark.createDataFrame(
        [
            (test, "o/r", n, workflow, datetime(2024, 1, 1) + timedelta(hours=n), o == "F")
            for n, o in enumerate(outcomes)
        ],
        "test_name string, repo_name string, run_id bigint, workflow_name string, "
        "created_at timestamp, failed boolean",
    )


@pytest.mark.parametrize(
    "outcomes, flaky, recent, streak",
    [
        ("." * 17 + "FFF", True, 3, 3),
        ("FFF" + "." * 17, True, 0, 0),
        ("." * 9 + "F", True, 1, 1),
        ("." * 19 + "F", False, None, None),
        ("F.F.F.F.F.", True, 5, 1),
        ("FFFFFF....", False, None, None),
        ("." * 8 + "FFFF" + "." * 8, True, 2, 2),
    ],
)
def test_flaky(spark, outcomes, flaky, recent, streak):
    found = ci.flaky_tests(results(spark, outcomes), ["release"]).collect()
    assert len(found) == int(flaky)
    if flaky:
        row = found[0]
        assert (row["recent_failures"], row["longest_streak"]) == (recent, streak)
        assert row["has_trend"] == (streak >= 3)
        assert row["failure_rate"] == outcomes.count("F") / len(outcomes)
        assert row["total_runs"] == len(outcomes) and row["severity"] == "normal"
        last = max(n for n, o in enumerate(outcomes) if o == "F")
        assert row["last_detected"] == datetime(2024, 1, 1) + timedelta(hours=last)


def test_flaky_in_a_critical_workflow(spark):
    both = results(spark, "F...", workflow="release").unionByName(results(spark, "...."))
    row = ci.flaky_tests(both, ["release"]).first()
    assert row["severity"] == "high" and row["total_runs"] == 8


def test_top_labels_counts_each_label_of_an_issue(spark):
    when = datetime(2024, 1, 30)
    data = [
        (1, 1, "t", "", ["a", "b"], "open", when, None, "u", "o/r"),
        (2, 2, "t", "", ["a"], "open", when, None, "u", "o/r"),
        (3, 3, "t", "", [], "open", when, None, "u", "o/r"),
        (4, 4, "t", "", ["c"], "open", datetime(2023, 1, 1), None, "u", "o/r"),
    ]
    df = spark.createDataFrame(data, ISSUES)
    assert [tuple(r) for r in issues.top_labels(df, AS_OF).collect()] == [("a", 2), ("b", 1)]
    assert [r["label"] for r in issues.top_labels(df, limit=2).collect()] == ["a", "b"]


def _takes_repos():
    """Every operator with a ``repos`` argument, found by its signature."""
    import inspect

    from repolume.operators import forecast

    modules = (anomalies, contributors, delivery, forecast, issues, repositories, traffic)
    for module in modules:
        for name, function in vars(module).items():
            if (
                inspect.isfunction(function)
                and function.__module__ == module.__name__
                and not name.startswith("_")
                and "repos" in (parameters := inspect.signature(function).parameters)
            ):
                yield f"{module.__name__.split('.')[-1]}.{name}", function, list(parameters)


@pytest.mark.parametrize("name, operator, parameters", list(_takes_repos()), ids=lambda x: x if isinstance(x, str) else "")
def test_repositories_as_a_list_and_as_a_frame(spark, name, operator, parameters):
    from repolume.streaming.rollup import rollup_delta

    events, issue_rows = on_sf(spark)
    given = {
        "events": events,
        "issues": issue_rows,
        "rollup": rollup_delta(events),
        "forecasts": t.forecast_standin(spark, SF_DIR),
        "as_of": AS_OF,
        "training_date": AS_OF,
    }
    arguments = {p: given[p] for p in parameters if p in given}
    if "steps" in parameters:
        arguments["steps"] = delivery.full_steps(DEFAULTS)
    some = [r[0] for r in events.select("repo_name").distinct().orderBy("repo_name").limit(2).collect()]
    frame = spark.createDataFrame([(r,) for r in [*some, some[0]]], "name string")

    def found(repos):
        return sorted(map(str, operator(**arguments, repos=repos).collect()))

    assert found(some) == found(frame)
    everything = found(None)
    if len(everything) > 1:
        assert found(some) != everything
