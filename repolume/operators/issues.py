"""Issues by state, label and day; predictions by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, day, in_repos, last_days


def issues_by_state(issues: DataFrame, repos=None) -> DataFrame:
    """Issues per repository and state."""
    return in_repos(issues, repos).groupBy("repo_name", "state").agg(
        F.count("*").alias("total")
    )


def open_issues(issues: DataFrame, repos=None, by_repo: bool = False) -> DataFrame:
    """Open and closed issues, over all chosen repositories or per repository."""
    keys = ["repo_name"] if by_repo else []
    return in_repos(issues, repos).groupBy(*keys).agg(
        F.count_if(F.col("state") == "open").alias("open_issues"),
        F.count_if(F.col("state") == "closed").alias("closed_issues"),
    )


def top_labels(
    issues: DataFrame,
    as_of: AsOf | None = None,
    days: int = 7,
    limit: int = 10,
    repos=None,
) -> DataFrame:
    """The most used labels, all time or of the last ``days``; an issue without
    labels counts nowhere."""
    chosen = issues if as_of is None else last_days(issues, as_of, days)
    return (
        in_repos(chosen, repos)
        .select(F.explode("labels").alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "label")
        .limit(limit)
    )


def issues_created_daily(issues: DataFrame, repos=None) -> DataFrame:
    """Issues opened per repository and day."""
    return in_repos(issues, repos).groupBy(
        "repo_name", day(F.col("created_at")).alias("time")
    ).agg(F.count("*").alias("issues"))


def predicted_label_distribution(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy("predicted_label")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "predicted_label")
    )
