import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolume.operators import repositories
from repolume.sources.tables import append_events
from repolume.streaming import actors, rollup

AS_OF = "2024-03-01"
TYPES = ["PushEvent", "PullRequestEvent", "IssuesEvent", "WatchEvent", "ForkEvent", "OtherEvent"]


def events(spark, seed, count, people=40, repos=3, days=100):
    rng = random.Random(seed)
    rows = [
        (
            str(i),
            rng.choice(TYPES),
            None if rng.random() < 0.02 else f"a{rng.randrange(people)}",
            f"o/r{rng.randrange(repos)}",
            datetime(2024, 3, 1) - timedelta(minutes=rng.randrange(1, days * 1440)),
            "{}",
            None,
        )
        for i in range(count)
    ]
    return spark.createDataFrame(
        rows,
        "id string, type string, actor_login string, repo_name string, created_at timestamp, "
        "payload string, org_login string",
    )


def stored(spark, data, path, loads=3):
    for load in range(loads):
        part = data.where(F.col("id").cast("int") % loads == load)
        rollup.append_delta(actors.actor_delta(part), path, load_id=load)
        rollup.append_delta(actors.actor_delta(part), path, load_id=load)  # a repeated load
    return spark.read.parquet(path)


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def test_rollup_gives_the_rows_of_the_events(spark, tmp_path):
    data = events(spark, 1, 3000)
    table = stored(spark, data, str(tmp_path / "actors"))
    for name, of_rollup, days in (
        ("developer_velocity", actors.velocity_from_rollup, 30),
        ("community_health", actors.health_from_rollup, 60),
        ("trending_repositories", actors.trending_from_rollup, 7),
    ):
        exact = getattr(repositories, name)(data, AS_OF, days)
        assert rows(of_rollup(table, AS_OF, days)) == rows(exact), name
    only = actors.velocity_from_rollup(table, AS_OF, 30, ["o/r1"])
    assert [r.repo_name for r in only.collect()] == ["o/r1"]


def test_the_events_are_not_read(spark, tmp_path):
    data = events(spark, 2, 200)
    append_events(data, str(tmp_path / "events"))
    table = stored(spark, spark.read.parquet(str(tmp_path / "events")), str(tmp_path / "actors"))
    plan = actors.health_from_rollup(table, AS_OF)._jdf.queryExecution().toString()
    assert "/actors" in plan and "/events" not in plan


def test_flow_of_contributors(spark, tmp_path):
    data = events(spark, 3, 600, people=60, days=25)
    table = stored(spark, data, str(tmp_path / "actors"))
    sets = {}
    for r in data.where("actor_login IS NOT NULL").collect():
        age = (date(2024, 3, 1) - r.created_at.date()).days
        if 1 <= age <= 14:
            before, during = sets.setdefault(r.repo_name, (set(), set()))
            (during if age <= 7 else before).add(r.actor_login)
    want = {
        repo: (len(a), len(b), len(a & b), len(b - a), len(a - b)) for repo, (a, b) in sets.items()
    }
    got = {r[0]: tuple(r)[1:] for r in actors.contributor_flow(table, AS_OF, 7).collect()}
    assert got == want


def test_large_sets_stay_within_the_stated_error(spark, tmp_path):
    """30,000 people, 10,000 of them in both windows."""
    people = spark.range(30_000).select(
        F.concat(F.lit("a"), "id").alias("actor_login"), (F.col("id") < 20_000).alias("old"),
        (F.col("id") >= 10_000).alias("new"),
    )
    old = people.where("old").withColumn("created_at", F.lit(datetime(2024, 2, 18)))
    new = people.where("new").withColumn("created_at", F.lit(datetime(2024, 2, 27)))
    data = old.unionByName(new).select(
        F.lit("x").alias("id"), F.lit("PushEvent").alias("type"), "actor_login",
        F.lit("o/r").alias("repo_name"), "created_at",
    )
    row = actors.contributor_flow(actors.actor_delta(data), AS_OF, 7).first()
    error = 4 * 30_000 / 2 ** (actors.LOG_ENTRIES / 2)
    for name, size in (("before", 20_000), ("during", 20_000), ("retained", 10_000), ("left", 10_000)):
        assert row[name] == pytest.approx(size, abs=error)
    assert row.retained + row.joined == pytest.approx(row.during, abs=error)


def test_empty_rollup(spark, tmp_path):
    table = actors.actor_delta(events(spark, 4, 10)).where("event_count < 0")
    assert actors.velocity_from_rollup(table, AS_OF).collect() == []
    assert actors.contributor_flow(table, AS_OF).collect() == []
