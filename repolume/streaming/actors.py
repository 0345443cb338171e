"""The rollup of actors: per day and repository, counts by kind and a theta sketch of actors.

It is an append-only table of deltas like the daily rollup. Theta sketches can be united,
intersected and subtracted, so any window of whole days is answered from the rollup: who was
active in it, who came back, who came new and who left. Up to 2 ** LOG_ENTRIES distinct
actors a sketch is exact; beyond, its error is about 1 / sqrt(2 ** LOG_ENTRIES), 1.6 %, of the
larger set for unions, and of the united sets for intersections and differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime, day, days_before, from_time, in_repos
from repolume.operators.repositories import rated_health, rated_trends, rated_velocity

LOG_ENTRIES = 12
KINDS = {
    "push_events": "PushEvent",
    "pr_events": "PullRequestEvent",
    "issue_events": "IssuesEvent",
    "watch_events": "WatchEvent",
    "fork_events": "ForkEvent",
}


def actor_delta(events: DataFrame, *load: str) -> DataFrame:
    """The delta rows of a block of events (of each load, if ``load`` columns are named).
    Events are counted per actor first, so a sketch is made once per key and task."""
    key = [*load, "date", "repo_name"]
    counts = [F.count_if(F.col("type") == kind).alias(name) for name, kind in KINDS.items()]
    per_actor = events.groupBy(
        *load, day(F.col("created_at")).alias("date"), "repo_name", "actor_login"
    ).agg(F.count("*").alias("event_count"), *counts)
    return per_actor.groupBy(*key).agg(
        *(F.sum(c).alias(c) for c in ("event_count", *KINDS)),
        F.theta_sketch_agg("actor_login", LOG_ENTRIES).alias("actors"),
    )


def _actors(condition: Column | None = None) -> Column:
    """The sketch of the actors of the rows that meet a condition."""
    chosen = F.col("actors") if condition is None else F.when(condition, F.col("actors"))
    return F.theta_union_agg(chosen, LOG_ENTRIES)


def _since(rollup: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    return from_time(rollup, days_before(as_of, days), "date")


def velocity_from_rollup(rollup: DataFrame, as_of: AsOf, days: int = 30, repos=None) -> DataFrame:
    """``developer_velocity`` for whole days, without reading the events."""
    counted = in_repos(_since(rollup, as_of, days), repos).groupBy("repo_name").agg(
        *(F.sum(c).alias(c) for c in KINDS if c != "fork_events"),
        F.theta_sketch_estimate(_actors()).alias("active_developers"),
        F.count_distinct("date").alias("active_days"),
        F.sum("event_count").alias("all_events"),
    )
    return rated_velocity(counted)


def health_from_rollup(rollup: DataFrame, as_of: AsOf, days: int = 90, repos=None) -> DataFrame:
    """``community_health`` with a look-back of whole days, without reading the events."""
    recent = F.col("date") >= F.lit(days_before(as_of, days).date())
    per_repo = in_repos(rollup, repos).groupBy("repo_name").agg(
        F.sum("event_count").alias("total_events"),
        F.theta_sketch_estimate(_actors()).alias("total_contributors"),
        F.coalesce(F.theta_sketch_estimate(_actors(recent)), F.lit(0)).alias("recent_contributors"),
        F.sum("watch_events").alias("stars"),
        F.sum("fork_events").alias("forks"),
        F.sum("issue_events").alias("total_issues"),
        F.sum("pr_events").alias("total_prs"),
        F.min("date").alias("first_event_date"),
    )
    return rated_health(per_repo)


def trending_from_rollup(rollup: DataFrame, as_of: AsOf, days: int = 7, limit: int = 10) -> DataFrame:
    """``trending_repositories`` for whole days, without reading the events."""
    counted = _since(rollup, as_of, days).groupBy("repo_name").agg(
        F.sum("event_count").alias("event_count"),
        F.theta_sketch_estimate(_actors()).alias("contributor_count"),
        F.sum("watch_events").alias("new_stars"),
        F.sum("fork_events").alias("new_forks"),
    )
    return rated_trends(counted, days, limit)


def contributor_flow(rollup: DataFrame, as_of: AsOf, days: int = 7, repos=None) -> DataFrame:
    """repo_name, before, during, retained, joined, left: the actors of the ``days`` up to
    ``as_of`` beside those of as many days before; how many were in both, and in one alone.

    A repository that had no actor in either window has no row.
    """
    edge = F.lit(days_before(as_of, days).date())
    recent = in_repos(_since(rollup, as_of, 2 * days), repos).where(
        F.col("date") < F.lit(as_datetime(as_of).date())
    )
    sets = recent.groupBy("repo_name").agg(
        _actors(F.col("date") < edge).alias("a"), _actors(F.col("date") >= edge).alias("b")
    )
    size = F.theta_sketch_estimate
    return sets.select(
        "repo_name",
        size("a").alias("before"),
        size("b").alias("during"),
        size(F.theta_intersection("a", "b")).alias("retained"),
        size(F.theta_difference("b", "a")).alias("joined"),
        size(F.theta_difference("a", "b")).alias("left"),
    )
