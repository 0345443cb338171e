"""One scan feeds all panels; each panel equals the query of its own."""

from pyspark.sql import functions as F

from repolume.operators import contributors, issues, panels, repositories, traffic

EVENTS = "id string, type string, actor_login string, repo_name string, created_at timestamp_ntz"
START, END = "2024-01-01 00:00:00", "2024-01-03 12:00:00"


def activity(spark, folder, many=400):
    rows = spark.range(many).selectExpr(
        "cast(id as string) as id",
        "concat('T', id % 3) as type",
        "concat('dev', id * id % 37) as actor_login",
        # one repository holds half of all rows
        "concat('org/r', if(id % 2 = 0, 0, id % 23)) as repo_name",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 13 * id) as created_at",
    )
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_event_panels_equal_their_queries(spark, tmp_path):
    events = activity(spark, str(tmp_path / "events"))
    report = panels.event_panels(events, START, END).cache()
    args = {"start": START, "end": END}

    def of(name, *columns):
        return rows_of(panels.panel(report, name), *columns)

    ranking = repositories.repo_activity_ranking(events, **args)
    assert of("repositories", "key", "count", "others") == rows_of(
        ranking, "repo_name", "events", "contributors"
    )
    top = contributors.top_contributors(events, **args)
    assert of("contributors", "key", "count", "others") == rows_of(
        top, "contributor", "events", "repos"
    )
    ranks = panels.panel(report, "contributors").orderBy("rank").collect()
    assert [r.rank for r in ranks] == list(range(1, 16))
    assert ranks == sorted(ranks, key=lambda r: (-r["count"], r.key))
    assert of("types", "key", "count") == rows_of(
        traffic.event_type_counts(events, START, END), "event_type", "count"
    )
    daily = traffic.event_traffic_daily(events, START, END)
    assert of("days", "key", "count") == rows_of(daily, F.col("time").cast("string"), "events")
    hourly = traffic.hourly_activity(events, START, END)
    assert of("hours", "key", "count") == rows_of(hourly, F.col("time").cast("string"), "events")
    report.unpersist()


def test_event_panels_read_the_table_once(spark, tmp_path):
    report = panels.event_panels(activity(spark, str(tmp_path / "events")), START, END)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "WindowGroupLimit" in plan


def test_event_panels_of_odd_rows(spark):
    assert panels.event_panels(spark.createDataFrame([], EVENTS)).count() == 0
    rows = [("1", None, None, None, None), ("1", None, None, None, None)]
    report = panels.event_panels(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted((r.panel, r.key, r["count"], r.others, r.rank) for r in report) == [
        ("contributors", None, 2, 0, 1),
        ("days", None, 2, None, None),
        ("hours", None, 2, None, None),
        ("repositories", None, 2, 0, 1),
        ("types", None, 2, None, None),
    ]


def test_issue_panels_equal_their_queries(spark):
    rows = spark.range(200).selectExpr(
        "concat('org/r', id % 4) as repo_name",
        "if(id % 3 = 0, 'open', 'closed') as state",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, id) as created_at",
        """case id % 5 when 0 then cast(null as array<string>) when 1 then array()
           else array(concat('l', id % 13), 'all') end as labels""",
    )
    report = panels.issue_panels(rows)

    def of(name, *columns):
        return rows_of(panels.panel(report, name), *columns)

    assert of("labels", "key", "count") == rows_of(issues.top_labels(rows), "label", "count")
    assert of("states", "repo_name", "key", "count") == rows_of(
        issues.issues_by_state(rows), "repo_name", "state", "total"
    )
    created = issues.issues_created_daily(rows)
    assert of("days", "repo_name", "key", "count") == rows_of(
        created, "repo_name", F.col("time").cast("string"), "issues"
    )
