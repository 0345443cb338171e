"""Repositories: statistics, profiles, velocity, community health, trends, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.functions import scores
from repolume.functions.scores import distinct_count, round2
from repolume.functions.timecols import (
    AsOf,
    day,
    days_before,
    in_range,
    in_repos,
    last_days,
    time_literal,
)


def _type_is(name: str):
    return F.col("type") == name


def repository_stats(events: DataFrame, repos=None, approx: bool = False) -> DataFrame:
    """Events, contributors and time of the last event of each repository."""
    return in_repos(events, repos).groupBy("repo_name").agg(
        F.count("*").alias("total_events"),
        distinct_count(F.col("actor_login"), approx).alias("unique_contributors"),
        F.max("created_at").alias("last_activity"),
    )


def _entries(condition=None):
    """(type, count) pairs as a map; one entry per event type, a small vocabulary."""
    pair = F.struct("type", "n")
    return F.map_from_entries(
        F.sort_array(F.collect_list(pair if condition is None else F.when(condition, pair)))
    )


def repository_profile(events: DataFrame, repos=None) -> DataFrame:
    """Repository statistics with a map from event type to count.

    Two grouping sets of one scan, by type and by actor, folded to one row per
    repository; the first step spreads a large repository over its actors.
    """
    chosen = in_repos(events, repos).select("repo_name", "type", "actor_login", "created_at")
    sets = [["repo_name", "type"], ["repo_name", "actor_login"]]
    parts = chosen.groupingSets(sets, "repo_name", "type", "actor_login").agg(
        F.count("*").alias("n"),
        F.max("created_at").alias("last"),
        (F.grouping("type") == 0).alias("is_type"),
    )
    return parts.groupBy("repo_name").agg(
        F.sum(F.when(F.col("is_type"), F.col("n"))).alias("total_events"),
        F.count(F.when(~F.col("is_type"), F.col("actor_login"))).alias("unique_contributors"),
        F.max("last").alias("last_activity"),
        _entries(F.col("is_type")).alias("event_types"),
    )


def contributor_stats(events: DataFrame, actors: list[str] | None = None) -> DataFrame:
    """Events, first and last time, and a map from event type to count, per actor."""
    per_type = in_repos(events, actors, "actor_login").groupBy("actor_login", "type").agg(
        F.count("*").alias("n"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
    )
    return per_type.groupBy(F.col("actor_login").alias("username")).agg(
        F.sum("n").alias("total_contributions"),
        F.min("first").alias("first_contribution"),
        F.max("last").alias("last_contribution"),
        _entries().alias("contribution_types"),
    )


def detailed_analytics(
    events: DataFrame, as_of: AsOf, days: int = 30, repos=None, approx: bool = False
) -> DataFrame:
    """Events and users per repository, day and event type.

    The rows carry no order: sort at the point of display, by date and
    ``event_count`` descending.
    """
    recent = in_repos(last_days(events, as_of, days), repos)
    return recent.groupBy(
        "repo_name", day(F.col("created_at")).alias("date"), F.col("type").alias("event_type")
    ).agg(
        F.count("*").alias("event_count"),
        distinct_count(F.col("actor_login"), approx).alias("unique_users"),
    )


def detailed_analytics_from_rollup(
    rollup: DataFrame, as_of: AsOf, days: int = 30, repos=None
) -> DataFrame:
    """``detailed_analytics`` for whole days, read from the sketch rollup; users
    are estimated."""
    recent = in_repos(last_days(rollup, as_of, days, "date"), repos)
    return recent.groupBy("repo_name", "date", "event_type").agg(
        F.sum("event_count").alias("event_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users"),
    )


def event_type_summary(
    events: DataFrame, as_of: AsOf, days: int = 30, repos=None
) -> DataFrame:
    """Events per repository and type in the look-back."""
    recent = in_repos(last_days(events, as_of, days), repos)
    return recent.groupBy("repo_name", F.col("type").alias("event_type")).agg(
        F.count("*").alias("event_count")
    )


def detailed_analytics_nested(
    events: DataFrame, as_of: AsOf, days: int = 30, repos=None, approx: bool = False
) -> DataFrame:
    """``detailed_analytics`` as one row per repository: a map from date to a map
    from type to counts, and the totals by type. A row has at most one entry per
    day and event type of the look-back."""
    flat = detailed_analytics(events, as_of, days, repos, approx)
    counts = F.struct(F.col("event_count").alias("count"), "unique_users")
    by_type = F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", counts))))
    per_day = flat.groupBy("repo_name", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        by_type.alias("types")
    )
    nested = per_day.groupBy("repo_name").agg(
        F.sort_array(F.collect_list(F.struct("date", F.map_entries("types").alias("e")))).alias("d")
    )
    entries = F.flatten(F.transform("d", lambda x: x["e"]))
    types = F.array_sort(F.array_distinct(F.transform(entries, lambda x: x["key"])))

    def total(name):
        of_type = F.filter(entries, lambda x: x["key"] == name)
        return F.aggregate(of_type, F.lit(0).cast("bigint"), lambda acc, x: acc + x["value"]["count"])

    return nested.select(
        "repo_name",
        F.lit(days).alias("period_days"),
        F.map_from_entries(
            F.transform("d", lambda x: F.struct(x["date"], F.map_from_entries(x["e"])))
        ).alias("daily_breakdown"),
        F.map_from_arrays(types, F.transform(types, total)).alias("event_type_summary"),
    )


def developer_velocity(
    events: DataFrame, as_of: AsOf, days: int = 30, repos=None, approx: bool = False
) -> DataFrame:
    """Activity counts of each repository and a score from 0 to 100."""
    counted = in_repos(last_days(events, as_of, days), repos).groupBy("repo_name").agg(
        F.count_if(_type_is("PushEvent")).alias("push_events"),
        F.count_if(_type_is("PullRequestEvent")).alias("pr_events"),
        F.count_if(_type_is("IssuesEvent")).alias("issue_events"),
        F.count_if(_type_is("WatchEvent")).alias("watch_events"),
        distinct_count(F.col("actor_login"), approx).alias("active_developers"),
        distinct_count(day(F.col("created_at")), approx).alias("active_days"),
        F.count("*").alias("all_events"),
    )
    return rated_velocity(counted)


def rated_velocity(counted: DataFrame) -> DataFrame:
    """The counts of each repository with events per active day and the score."""
    per_day = counted.withColumn(
        "events_per_day", round2(F.col("all_events") / F.col("active_days"))
    ).drop("all_events")
    return per_day.withColumn(
        "velocity_score",
        scores.velocity_score(
            F.col("push_events"),
            F.col("pr_events"),
            F.col("active_developers"),
            F.col("events_per_day"),
        ),
    )


def community_health(
    events: DataFrame, as_of: AsOf, days: int = 90, repos=None
) -> DataFrame:
    """All-time totals, contributors of the last ``days``, retention and a score.

    One pass: rows are folded to one per (repository, actor), where a recent
    contributor is one whose last event lies in the look-back, and then counted.
    """
    cut = time_literal(events, "created_at", days_before(as_of, days))
    per_actor = in_repos(events, repos).groupBy("repo_name", "actor_login").agg(
        F.count("*").alias("events"),
        F.count_if(_type_is("WatchEvent")).alias("stars"),
        F.count_if(_type_is("ForkEvent")).alias("forks"),
        F.count_if(_type_is("IssuesEvent")).alias("issues"),
        F.count_if(_type_is("PullRequestEvent")).alias("prs"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
    )
    per_repo = per_actor.groupBy("repo_name").agg(
        F.sum("events").alias("total_events"),
        F.count("actor_login").alias("total_contributors"),
        F.count_if(F.col("actor_login").isNotNull() & (F.col("last") >= cut)).alias(
            "recent_contributors"
        ),
        F.sum("stars").alias("stars"),
        F.sum("forks").alias("forks"),
        F.sum("issues").alias("total_issues"),
        F.sum("prs").alias("total_prs"),
        day(F.min("first")).alias("first_event_date"),
    )
    return rated_health(per_repo)


def rated_health(per_repo: DataFrame) -> DataFrame:
    """The totals of each repository with retention and the score."""
    rated = per_repo.withColumn(
        "contributor_retention_rate",
        round2(scores.percent(F.col("recent_contributors"), F.col("total_contributors"))),
    )
    return rated.withColumn(
        "health_score",
        scores.health_score(
            F.col("total_contributors"),
            F.col("contributor_retention_rate"),
            F.col("total_events"),
            F.col("stars") + F.col("forks"),
        ),
    )


def trending_repositories(
    events: DataFrame, as_of: AsOf, days: int = 7, limit: int = 10, approx: bool = False
) -> DataFrame:
    """The repositories with the highest trend score of the look-back."""
    counted = last_days(events, as_of, days).groupBy("repo_name").agg(
        F.count("*").alias("event_count"),
        distinct_count(F.col("actor_login"), approx).alias("contributor_count"),
        F.count_if(_type_is("WatchEvent")).alias("new_stars"),
        F.count_if(_type_is("ForkEvent")).alias("new_forks"),
    )
    return rated_trends(counted, days, limit)


def rated_trends(counted: DataFrame, days: int, limit: int) -> DataFrame:
    """The highest trend scores of the counts of each repository."""
    points = F.col("new_stars") * 3 + F.col("new_forks") * 2 + F.col("contributor_count")
    return (
        counted.withColumn("daily_avg_events", round2(F.col("event_count") / days))
        .withColumn("trend_score", round2(points / days))
        .orderBy(F.desc("trend_score"), "repo_name")
        .limit(limit)
        .withColumn("trend_level", scores.trend_level(F.col("trend_score")))
        .withColumnRenamed("repo_name", "repository")
    )


def list_repos(events: DataFrame) -> DataFrame:
    return events.select("repo_name").distinct().orderBy("repo_name")


def list_event_types(events: DataFrame) -> DataFrame:
    return events.select(F.col("type").alias("event_type")).distinct().orderBy("event_type")


def repo_activity_ranking(
    events: DataFrame,
    as_of: AsOf | None = None,
    days: int = 30,
    limit: int | None = 10,
    start: AsOf | None = None,
    end: AsOf | None = None,
    repos=None,
    approx: bool = False,
) -> DataFrame:
    """Repositories by number of events: the last ``days``, or a range, or all
    time; ``limit=None`` gives a summary row for every one."""
    chosen = last_days(events, as_of, days) if as_of is not None else in_range(events, start, end)
    ranked = in_repos(chosen, repos).groupBy("repo_name").agg(
        F.count("*").alias("events"),
        distinct_count(F.col("actor_login"), approx).alias("contributors"),
    )
    if limit is None:
        return ranked
    return ranked.orderBy(F.desc("events"), "repo_name").limit(limit)
