import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from repolume.functions import scores
from repolume.functions import timecols as tc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "day, week, start",
    [
        ("2023-01-01", 1, "2023-01-01"),
        ("2024-01-01", 0, "2023-12-31"),
        ("2024-01-06", 0, "2023-12-31"),
        ("2024-01-07", 1, "2024-01-07"),
        ("2022-12-31", 52, "2022-12-25"),
    ],
)
def test_weeks_begin_on_sunday(spark, day, week, start):
    d = F.lit(date.fromisoformat(day))
    assert one(spark, tc.week_number(d)) == week
    assert one(spark, tc.week_start(d)) == date.fromisoformat(start)


@pytest.mark.parametrize(
    "start, end, hours",
    [
        ("2024-01-01 00:59:00", "2024-01-01 01:01:00", 1),
        ("2024-01-01 00:00:00", "2024-01-01 00:59:59", 0),
        ("2024-01-01 10:30:00", "2024-01-01 08:10:00", -2),
        ("1969-12-31 23:59:00", "1970-01-01 00:01:00", 1),
    ],
)
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_hours_crossed(spark, start, end, hours, kind):
    column = tc.hours_crossed(F.lit(start).cast(kind), F.lit(end).cast(kind))
    assert one(spark, column) == hours


def test_score_rounding_is_that_of_exact_values(spark):
    random.seed(1)
    values = [random.uniform(0, 100) for _ in range(2000)]
    values += [n / 1000 + 0.005 for n in range(0, 3000, 7)] + [2.675, 1.005, 0.125, 0.375, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", scores.round2_exact(F.col("v")).alias("r")).collect()
    assert all(r["r"] == round(r["v"], 2) for r in got)


def test_ratio_rounding_ties_to_even(spark):
    for value, expected in [(0.125, 0.12), (0.375, 0.38), (7 / 3, 2.33), (5 / 8, 0.62)]:
        assert one(spark, scores.round2(F.lit(value))) == expected


@pytest.mark.parametrize(
    "score, level",
    [(20.0, "high"), (19.99, "medium"), (10.0, "medium"), (5.0, "low"), (4.99, "stable")],
)
def test_trend_levels(spark, score, level):
    assert one(spark, scores.trend_level(F.lit(score))) == level


def test_band_takes_highest_step_reached(spark):
    steps = [(0.0, "green"), (7.5, "yellow"), (15.0, "red")]
    found = [one(spark, scores.band(F.lit(v), steps)) for v in (0.0, 7.49, 7.5, 15.0, 99.0)]
    assert found == ["green", "green", "yellow", "red", "red"]
    assert one(spark, scores.band(F.lit(None).cast("double"), steps)) is None


def test_healthy_at_the_limit(spark):
    assert one(spark, scores.health_status(F.lit(5), F.lit(5.0))) == scores.HEALTHY
    assert one(spark, scores.health_status(F.lit(6), F.lit(5.0))) == scores.UNHEALTHY


def test_percent_of_nothing_is_null(spark):
    assert one(spark, scores.percent(F.lit(0), F.lit(0))) is None


def test_reference_times():
    expected = datetime(2024, 1, 31)
    for value in ("2024-01-31", "2024-01-31 00:00:00", "2024-01-31T01:00:00+01:00",
                  date(2024, 1, 31), expected):
        assert tc.as_datetime(value) == expected


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_look_back_has_no_upper_bound_and_includes_its_edge(spark, kind):
    times = ["2024-01-23 23:59:59", "2024-01-24 00:00:00", "2030-01-01 00:00:00"]
    df = spark.createDataFrame([(x,) for x in times], "s string").select(
        F.col("s").cast(kind).alias("created_at")
    )
    assert tc.last_days(df, "2024-01-31", 7).count() == 2
    assert tc.last_days(df, "2024-01-31", 7, strict=True).count() == 1
    assert tc.in_range(df, "2024-01-23 23:59:59", "2024-01-24").count() == 2


def test_repository_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_name string")
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "name string")
    assert tc.in_repos(df, None).count() == 3
    assert tc.in_repos(df, ["a", "b"]).count() == 2
    assert tc.in_repos(df, wanted).count() == 1
