"""Contributors ranked over all repositories or within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolume.functions.scores import distinct_count
from repolume.functions.timecols import AsOf, in_range, in_repos, last_days


def top_contributors(
    events: DataFrame,
    as_of: AsOf | None = None,
    days: int = 30,
    limit: int = 15,
    start: AsOf | None = None,
    end: AsOf | None = None,
    repos=None,
    approx: bool = False,
) -> DataFrame:
    """Actors by number of events, with the repositories they touched: the last
    ``days`` before ``as_of``, or a range."""
    chosen = last_days(events, as_of, days) if as_of is not None else in_range(events, start, end)
    return (
        in_repos(chosen, repos)
        .groupBy(F.col("actor_login").alias("contributor"))
        .agg(
            F.count("*").alias("events"),
            distinct_count(F.col("repo_name"), approx).alias("repos"),
        )
        .orderBy(F.desc("events"), "contributor")
        .limit(limit)
    )


def top_contributors_by_repo(events: DataFrame, limit: int = 10, repos=None) -> DataFrame:
    """The most active actors of each repository, all time.

    Rank is limited within each task before rows meet by repository, so a large
    repository sends ``limit`` rows per task.
    """
    counted = in_repos(events, repos).groupBy("repo_name", "actor_login").agg(
        F.count("*").alias("events")
    )
    order = Window.partitionBy("repo_name").orderBy(F.desc("events"), "actor_login")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
