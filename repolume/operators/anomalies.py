"""Limits from daily counts, system health, anomalous days, data diagnostics.

Each operator scans a table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.functions import scores
from repolume.functions.timecols import (
    AsOf,
    as_datetime,
    day,
    days_before,
    from_time,
    last_days,
    start_of_day,
    time_literal,
)
from repolume.operators.delivery import is_bug, is_merged
from repolume.sources.thresholds import DEFAULTS


def _three_sigma(count: str) -> Column:
    return F.avg(count) + 3 * F.stddev_pop(count)


def _or_default(limit: Column, name: str) -> Column:
    """The fixed limit where the computed one is 0 or there is none."""
    usable = F.when((limit == 0) | F.isnan(limit), None).otherwise(limit)
    return F.coalesce(usable, F.lit(DEFAULTS[name]))


def _per_day(df: DataFrame, as_of: AsOf, days: int, name: str) -> DataFrame:
    return last_days(df, as_of, days).groupBy(day(F.col("created_at"))).agg(
        F.count("*").alias(name)
    ).select(name)


def dynamic_thresholds(
    events: DataFrame, issues: DataFrame, as_of: AsOf, days: int = 90
) -> DataFrame:
    """Mean plus three standard deviations of the daily counts (days with rows
    only), with the default where there are none; the other limits are fixed."""
    daily = _per_day(events, as_of, days, "events_per_day").unionByName(
        _per_day(issues, as_of, days, "issues_per_day"), allowMissingColumns=True
    )
    row = daily.agg(
        *[
            _or_default(_three_sigma(name), name).alias(name)
            for name in ("events_per_day", "issues_per_day")
        ]
    )
    fixed = [
        F.lit(DEFAULTS[name]).alias(name)
        for name in ("cfr_threshold", "mttr_threshold", "lead_time_threshold")
    ]
    return row.select("*", *fixed)


def _daily_profile(df: DataFrame, as_of: AsOf, days: int, failing: Column | None) -> DataFrame:
    """One row: the three-sigma limit, today's rows and today's failing rows."""
    since_today = F.col("created_at") >= time_literal(df, "created_at", start_of_day(as_of))
    failures = F.count_if(since_today & failing) if failing is not None else F.lit(0)
    daily = last_days(df, as_of, days).groupBy(day(F.col("created_at"))).agg(
        F.count("*").alias("n"),
        F.count_if(since_today).alias("today"),
        failures.alias("failing"),
    )
    return daily.agg(
        _three_sigma("n").alias("threshold"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today"),
        F.coalesce(F.sum("failing"), F.lit(0)).alias("failing"),
    )


def _health_row(metric: str, current: Column, threshold: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        current.cast("double").alias("current"),
        threshold.cast("double").alias("threshold"),
        scores.health_status(current, threshold).alias("status"),
    )


def system_health(
    events: DataFrame,
    issues: DataFrame,
    as_of: AsOf,
    days: int = 90,
    cfr_threshold: float = DEFAULTS["cfr_threshold"],
) -> DataFrame:
    """Today's events, issues and change failure rate against their limits. The
    rate counts bug mentions only."""
    of_events = _daily_profile(events, as_of, days, is_bug(events))
    of_issues = _daily_profile(issues, as_of, days, None)
    rate = F.coalesce(scores.percent(F.col("failing"), F.col("today")), F.lit(0.0))
    event_rows = F.array(
        _health_row("Events", F.col("today"), F.col("threshold")),
        _health_row("Change Failure Rate", rate, F.lit(float(cfr_threshold))),
    )
    issue_rows = F.array(_health_row("Issues", F.col("today"), F.col("threshold")))
    return of_events.select(F.inline(event_rows)).unionByName(
        of_issues.select(F.inline(issue_rows))
    )


def system_health_static(
    events: DataFrame,
    issues: DataFrame,
    as_of: AsOf,
    limits: dict[str, float] = DEFAULTS,
) -> DataFrame:
    """The last 24 hours against stored limits; the change failure rate, whose
    limit is fixed, is NULL and healthy without events."""
    of_events = last_days(events, as_of, 1).agg(
        F.count("*").alias("n"), F.count_if(is_bug(events)).alias("failing")
    )
    of_issues = last_days(issues, as_of, 1).agg(F.count("*").alias("n"))
    rate = scores.percent(F.col("failing"), F.col("n"))
    event_rows = F.array(
        _health_row("Events (24h)", F.col("n"), F.lit(float(limits["events_per_day"]))),
        _health_row("Change Failure Rate", rate, F.lit(DEFAULTS["cfr_threshold"])),
    )
    issue_rows = F.array(
        _health_row("Issues (24h)", F.col("n"), F.lit(float(limits["issues_per_day"])))
    )
    return of_events.select(F.inline(event_rows)).unionByName(
        of_issues.select(F.inline(issue_rows))
    )


def daily_anomalies(
    events: DataFrame,
    as_of: AsOf,
    days: int = 90,
    start: AsOf | None = None,
    end: AsOf | None = None,
    repos: list[str] | DataFrame | None = None,
) -> DataFrame:
    """Daily traffic of the chosen repositories and range beside the limit line
    of all repositories, and whether the day exceeds it.

    One scan counts both per day; the limit is then taken over the days.
    """
    in_look_back = F.col("created_at") >= time_literal(
        events, "created_at", days_before(as_of, days)
    )
    chosen = F.lit(True)
    if start is not None:
        chosen &= F.col("created_at") >= time_literal(events, "created_at", start)
    if end is not None:
        chosen &= F.col("created_at") <= time_literal(events, "created_at", end)
    first = days_before(as_of, days) if start is not None else None
    if first is not None:
        events = from_time(events, min(first, as_datetime(start)))
    if isinstance(repos, DataFrame):
        # rows are marked, not filtered: the limit is that of all repositories
        wanted = repos.select(F.col(repos.columns[0]).alias("repo_name")).distinct()
        events = events.join(wanted.withColumn("_wanted", F.lit(True)), "repo_name", "left")
        chosen &= F.col("_wanted").isNotNull()
    elif repos is not None:
        chosen &= F.col("repo_name").isin(list(repos))
    daily = events.groupBy(day(F.col("created_at")).alias("time")).agg(
        F.count_if(chosen).alias("events"), F.count_if(in_look_back).alias("n")
    )
    # one row per day by now, so all of them fit one task
    all_days = Window.partitionBy(F.lit(0))
    n = F.when(F.col("n") > 0, F.col("n"))
    line = F.avg(n).over(all_days) + 3 * F.stddev_pop(n).over(all_days)
    return (
        daily.withColumn("threshold", _or_default(line, "events_per_day"))
        .where("events > 0")
        .select(
            "time", "events", "threshold", (F.col("events") > F.col("threshold")).alias("is_anomaly")
        )
    )


def data_diagnostics(
    events: DataFrame, issues: DataFrame, forecasts: DataFrame, as_of: AsOf
) -> DataFrame:
    """Row counts that show whether the tables are filled, as (metric, value)."""

    def since(df: DataFrame, days: int) -> Column:
        return F.col("created_at") >= time_literal(df, "created_at", days_before(as_of, days))

    closed = (F.col("state") == "closed") & F.col("closed_at").isNotNull()
    # The nine names of the numbers.
    counts = [
        events.agg(
            F.count("*").alias("Total events"),
            F.count_if(since(events, 7)).alias("Events last 7d"),
            F.count_if(since(events, 30)).alias("Events last 30d"),
            F.count_if(is_merged(events)).alias("Merged PR events"),
        ),
        issues.agg(
            F.count("*").alias("Total issues"),
            F.count_if(since(issues, 7)).alias("Issues last 7d"),
            F.count_if(since(issues, 30)).alias("Issues last 30d"),
            F.count_if(closed).alias("Closed issues with closed_at"),
        ),
        forecasts.agg(F.count("*").alias("Total forecasts")),
    ]
    rows = [frame.unpivot([], frame.columns, "metric", "value") for frame in counts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def sample_repos(events: DataFrame, limit: int = 5) -> DataFrame:
    """A few repository names, the first in order."""
    return events.select("repo_name").distinct().orderBy("repo_name").limit(limit)
