"""Delivery metrics: deployments, lead time, time to resolve, change failures, bands.

Each works over all chosen repositories together, or per repository with
``by_repo``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolume.functions import scores
from repolume.functions.scores import round2
from repolume.functions.timecols import (
    AsOf,
    day,
    days_before,
    hours_crossed,
    in_repos,
    last_days,
    seconds_between,
    time_literal,
    week_number,
    week_start,
)
from repolume.sources.payloads import MERGED_AT, SAYS_BUG, SAYS_MERGED

Steps = list[tuple[float | None, str]]


def _keys(by_repo: bool) -> list[str]:
    return ["repo_name"] if by_repo else []


def _says(events: DataFrame | None, stored: str, word: str) -> Column:
    if events is not None and stored in events.columns:
        return F.col(stored)
    return F.col("payload").contains(word)


def is_merged(events: DataFrame | None = None) -> Column:
    """A pull-request event whose payload text mentions ``merged``, whatever its value."""
    return (F.col("type") == "PullRequestEvent") & _says(events, SAYS_MERGED, "merged")


def is_bug(events: DataFrame | None = None) -> Column:
    return _says(events, SAYS_BUG, "bug")


def is_failure(events: DataFrame | None = None) -> Column:
    return is_bug(events) | (F.col("type") == "IssuesEvent")


def merged_at(events: DataFrame) -> Column:
    """The payload's merge time; absent or unreadable text gives NULL."""
    if MERGED_AT in events.columns:
        return F.col(MERGED_AT)
    return F.get_json_object("payload", "$.pull_request.merged_at").try_cast(
        events.schema["created_at"].dataType
    )


def deployment_count(
    events: DataFrame, as_of: AsOf, days: int = 7, repos=None, by_repo: bool = False
) -> DataFrame:
    merged = in_repos(last_days(events, as_of, days), repos).where(is_merged(events))
    return merged.groupBy(*_keys(by_repo)).agg(F.count("*").alias("deployments"))


def deployment_frequency_weekly(
    events: DataFrame, as_of: AsOf, days: int = 90, repos=None
) -> DataFrame:
    """Deployments per week (beginning on Sunday): the number of the week in its
    year, and the date it begins on, which keeps weeks of two years apart."""
    merged = in_repos(last_days(events, as_of, days), repos).where(is_merged(events))
    date = day(F.col("created_at"))
    return (
        merged.groupBy(week_start(date).alias("week_start"), week_number(date).alias("time"))
        .agg(F.count("*").alias("deployments"))
        .orderBy("week_start", "time")
    )


def lead_time_hours(
    events: DataFrame, as_of: AsOf, days: int = 90, repos=None, by_repo: bool = False
) -> DataFrame:
    """Mean hours from a merge event to the ``merged_at`` in its payload, 0 if
    there is none; an absent or unreadable time is left out."""
    merged = in_repos(last_days(events, as_of, days), repos).where(is_merged(events))
    mean = F.avg(hours_crossed(F.col("created_at"), merged_at(events)))
    return merged.groupBy(*_keys(by_repo)).agg(F.coalesce(mean, F.lit(0.0)).alias("lead_time"))


def mttr_hours(
    issues: DataFrame,
    as_of: AsOf,
    days: int = 90,
    repos=None,
    by_repo: bool = False,
    default: float | None = 0.0,
) -> DataFrame:
    """Mean hours to close the issues opened in the look-back; ``default`` where
    none was closed (``None`` keeps NULL)."""
    closed = in_repos(last_days(issues, as_of, days), repos).where(
        (F.col("state") == "closed") & F.col("closed_at").isNotNull()
    )
    mean = F.avg(hours_crossed(F.col("created_at"), F.col("closed_at")))
    if default is not None:
        mean = F.coalesce(mean, F.lit(float(default)))
    return closed.groupBy(*_keys(by_repo)).agg(mean.alias("mttr"))


def mttr_hours_exact(issues: DataFrame, repos=None, by_repo: bool = True) -> DataFrame:
    """Mean hours to close from the seconds, two decimals, all time, any state."""
    closed = in_repos(issues, repos).where(F.col("closed_at").isNotNull())
    mean = F.avg(seconds_between(F.col("created_at"), F.col("closed_at")))
    return closed.groupBy(*_keys(by_repo)).agg(round2(mean / 3600.0).alias("mttr_hours"))


def change_failure_rate(
    events: DataFrame,
    as_of: AsOf,
    days: int = 7,
    repos=None,
    by_repo: bool = False,
    guarded: bool = True,
) -> DataFrame:
    """Percentage of events that mention a bug or concern an issue; without any
    event 0 if ``guarded``, else NULL."""
    recent = in_repos(last_days(events, as_of, days), repos)
    rate = scores.percent(F.count_if(is_failure(events)), F.count("*"))
    if guarded:
        rate = F.coalesce(rate, F.lit(0.0))
    return recent.groupBy(*_keys(by_repo)).agg(rate.alias("cfr"))


def limit_steps(limit: float) -> Steps:
    """Steps of a metric that should stay low: yellow from half the limit."""
    return [(0.0, "green"), (limit * 0.5, "yellow"), (limit, "red")]


def traffic_steps(events_per_day: float) -> Steps:
    return [(None, "green"), (events_per_day, "red")]


# Steps that depend on no limit.
DEPLOYMENT_STEPS = [(0.0, "red"), (5.0, "yellow"), (10.0, "green")]
OPEN_ISSUE_STEPS = [(0.0, "green"), (50.0, "yellow"), (100.0, "red")]
# The short report has steps of its own.
SHORT_STEPS = {
    "deployments": DEPLOYMENT_STEPS,
    "cfr": [(0.0, "green"), (15.0, "yellow"), (30.0, "red")],
    "mttr": [(0.0, "green"), (24.0, "yellow"), (72.0, "red")],
}


def full_steps(limits: dict[str, float]) -> dict[str, Steps]:
    """The steps of the full report, from the stored limits."""
    return {
        "lead_time": limit_steps(limits["lead_time_threshold"]),
        "mttr": limit_steps(limits["mttr_threshold"]),
        "cfr": limit_steps(limits["cfr_threshold"]),
        "deployments": DEPLOYMENT_STEPS,
        "open_issues": OPEN_ISSUE_STEPS,
    }


def with_band(df: DataFrame, column: str, steps: Steps) -> DataFrame:
    """Add the ``band`` colour of a metric column."""
    return df.withColumn("band", scores.band(F.col(column), steps))


def metric_bands(
    events: DataFrame,
    issues: DataFrame,
    as_of: AsOf,
    steps: dict[str, Steps],
    long_days: int = 90,
    short_days: int = 7,
    repos=None,
) -> DataFrame:
    """The metrics that ``steps`` names as rows (metric, value, band), each table
    read once. Lead time and time to resolve look back ``long_days``, failures
    and deployments ``short_days``."""
    recent = in_repos(last_days(events, as_of, long_days), repos)
    is_short = F.col("created_at") >= time_literal(
        events, "created_at", days_before(as_of, short_days)
    )
    issue_long = F.col("created_at") >= time_literal(
        issues, "created_at", days_before(as_of, long_days)
    )
    lead = F.avg(F.when(is_merged(events), hours_crossed(F.col("created_at"), merged_at(events))))
    failing = scores.percent(F.count_if(is_short & is_failure(events)), F.count_if(is_short))
    closed = issue_long & (F.col("state") == "closed")
    to_close = F.avg(F.when(closed, hours_crossed(F.col("created_at"), F.col("closed_at"))))
    of_events = {
        "lead_time": F.coalesce(lead, F.lit(0.0)),
        "cfr": F.coalesce(failing, F.lit(0.0)),
        "deployments": F.count_if(is_short & is_merged(events)).cast("double"),
    }
    of_issues = {
        "mttr": F.coalesce(to_close, F.lit(0.0)),
        "open_issues": F.count_if(F.col("state") == "open").cast("double"),
    }

    def rows(table: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        chosen = [name for name in metrics if name in steps]
        panels = [
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).alias("value"),
                scores.band(F.col(name), steps[name]).alias("band"),
            )
            for name in chosen
        ]
        row = table.agg(*[metrics[name].alias(name) for name in chosen])
        return row.select(F.inline(F.array(*panels)))

    return rows(recent, of_events).unionByName(rows(in_repos(issues, repos), of_issues))
