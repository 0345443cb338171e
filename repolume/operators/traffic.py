"""Event counts over time and by type, and release marks.

Reads either the event table or, where it says so, the daily rollup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolume.functions.scores import distinct_count
from repolume.functions.timecols import AsOf, day, in_range, in_repos, last_days, truncate_to


def _newest_days(daily: DataFrame, limit: int) -> DataFrame:
    newest = Window.partitionBy("repo_name").orderBy(F.desc("date"))
    return daily.withColumn("_rank", F.row_number().over(newest)).where(
        F.col("_rank") <= limit
    ).drop("_rank")


def daily_activity(
    events: DataFrame, limit: int = 30, repos=None, approx: bool = False
) -> DataFrame:
    """Events and contributors per day: the newest ``limit`` days of each
    repository that had events."""
    daily = in_repos(events, repos).groupBy(
        "repo_name", day(F.col("created_at")).alias("date")
    ).agg(
        F.count("*").alias("events"),
        distinct_count(F.col("actor_login"), approx).alias("contributors"),
    )
    return _newest_days(daily, limit)


def daily_activity_from_rollup(rollup: DataFrame, limit: int = 30, repos=None) -> DataFrame:
    """``daily_activity`` read from the sketch rollup; contributors are estimated."""
    daily = in_repos(rollup, repos).groupBy("repo_name", "date").agg(
        F.sum("event_count").alias("events"),
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("contributors"),
    )
    return _newest_days(daily, limit)


def event_type_counts(
    events: DataFrame, start: AsOf | None = None, end: AsOf | None = None, repos=None
) -> DataFrame:
    """Events by type over all chosen repositories."""
    chosen = in_repos(in_range(events, start, end), repos)
    return (
        chosen.groupBy(F.col("type").alias("event_type"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "event_type")
    )


def event_types_by_repo(events: DataFrame, repos=None) -> DataFrame:
    """Events by repository and type."""
    return in_repos(events, repos).groupBy("repo_name", "type").agg(
        F.count("*").alias("total")
    )


def event_traffic_daily(
    events: DataFrame, start: AsOf | None = None, end: AsOf | None = None, repos=None
) -> DataFrame:
    """Events per day over all chosen repositories, both ends of the range included."""
    chosen = in_repos(in_range(events, start, end), repos)
    return (
        chosen.groupBy(day(F.col("created_at")).alias("time"))
        .agg(F.count("*").alias("events"))
        .orderBy("time")
    )


def event_traffic_from_rollup(
    rollup: DataFrame, start: AsOf | None = None, end: AsOf | None = None, repos=None
) -> DataFrame:
    """``event_traffic_daily`` for whole days, read from the rollup."""
    chosen = in_repos(in_range(rollup, start, end, "date"), repos)
    return (
        chosen.groupBy(F.col("date").alias("time"))
        .agg(F.sum("event_count").alias("events"))
        .orderBy("time")
    )


def event_traffic_epoch_ms(events: DataFrame, repos=None) -> DataFrame:
    """Events per repository and day, the day as milliseconds since 1970."""
    days = in_repos(events, repos).groupBy("repo_name", day(F.col("created_at")).alias("d")).agg(
        F.count("*").alias("events")
    )
    millis = F.unix_date("d").cast("bigint") * 86_400_000
    return days.select("repo_name", millis.alias("time"), "events")


def hourly_activity(
    events: DataFrame, start: AsOf | None = None, end: AsOf | None = None, repos=None
) -> DataFrame:
    """Events per hour over all chosen repositories."""
    chosen = in_repos(in_range(events, start, end), repos)
    return (
        chosen.groupBy(truncate_to("hour", events, "created_at").alias("time"))
        .agg(F.count("*").alias("events"))
        .orderBy("time")
    )


def release_annotations(
    events: DataFrame, as_of: AsOf, days: int = 90, repos=None
) -> DataFrame:
    """A mark for each release event."""
    releases = in_repos(last_days(events, as_of, days), repos).where("type = 'ReleaseEvent'")
    return releases.select(
        F.col("created_at").alias("time"),
        F.concat(F.lit("Release: "), "payload").alias("text"),
        F.lit("release").alias("tags"),
    )
