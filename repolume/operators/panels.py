"""All panels of a dashboard from one scan of a time range, in long form.

Rows of every panel are told apart by grouping sets, so that the table is read once however
many panels there are. Each panel equals the query of its own in the other modules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, day, in_range, in_repos

# Rows of the ranked panels; all other panels are whole.
TOP_EVENTS = {"contributors": 15, "repositories": 10}
TOP_ISSUES = {"labels": 10}


def _row(panel: str, key: Column, **others: Column) -> Column:
    columns = [column.alias(name) for name, column in others.items()]
    return F.struct(F.lit(panel).alias("panel"), *columns, key.cast("string").alias("key"))


def _ranked(counted: DataFrame, top: dict[str, int]) -> DataFrame:
    """The first rows of each panel in ``top``, by count and then key, with their rank; the
    other panels whole, without one.

    Rows of panels without a rank are alone in their windows, so one limit holds for all and
    is applied within each task before the shuffle.
    """
    is_top = F.col("panel").isin(*top)
    keys = [F.when(~is_top, F.col(c)) for c in counted.columns if c in ("repo_name", "key")]
    order = Window.partitionBy("panel", *keys).orderBy(F.desc("count"), "key")
    limit = F.lit(max(top.values()))
    for panel, rows in top.items():
        limit = F.when(F.col("panel") == panel, rows).otherwise(limit)
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(top.values()))
        .where(F.col("rank") <= limit)
        .withColumn("rank", F.when(is_top, F.col("rank")))
    )


def event_panels(
    events: DataFrame,
    start: AsOf | None = None,
    end: AsOf | None = None,
    repos=None,
    top: dict[str, int] = TOP_EVENTS,
) -> DataFrame:
    """panel, key, count, others, rank of the events of a range: ``types``, ``days``, ``hours``
    (its beginning), ``repositories`` and ``contributors``.

    ``others`` counts the contributors of a repository and the repositories of a contributor,
    exactly: events are counted by pairs of the two first, which also spreads a repository
    with very many events over its contributors.
    """
    keys = {"day": day(F.col("created_at")), "hour": F.date_trunc("hour", "created_at")}
    chosen = in_repos(in_range(events, start, end), repos).select(
        "repo_name", "actor_login", "type", *[c.alias(name) for name, c in keys.items()]
    )
    columns = [F.col(c) for c in chosen.columns]
    repo, actor, kind, date, hour = columns
    # one pass: by pair of repository and actor, by type, by day, by hour
    sets = [[repo, actor], [kind], [date], [hour]]
    counted = chosen.groupingSets(sets, *columns).agg(
        F.grouping("repo_name").alias("no_pair"),
        F.grouping("type").alias("no_type"),
        F.grouping("day").alias("no_day"),
        F.count("*").alias("events"),
    )
    pair = F.array(_row("repositories", repo), _row("contributors", actor))
    rows = (
        F.when(F.col("no_pair") == 0, pair)
        .when(F.col("no_type") == 0, F.array(_row("types", kind)))
        .when(F.col("no_day") == 0, F.array(_row("days", date)))
        .otherwise(F.array(_row("hours", hour)))
    )
    other = F.when(
        F.col("panel") == "repositories", F.col("actor_login").isNotNull()
    ).when(F.col("panel") == "contributors", F.col("repo_name").isNotNull())
    panels = (
        counted.select("repo_name", "actor_login", "events", F.inline(rows))
        .groupBy("panel", "key")
        .agg(F.sum("events").alias("count"), F.sum(other.cast("long")).alias("others"))
    )
    return _ranked(panels, top)


def issue_panels(
    issues: DataFrame,
    start: AsOf | None = None,
    end: AsOf | None = None,
    repos=None,
    top: dict[str, int] = TOP_ISSUES,
) -> DataFrame:
    """panel, repo_name, key, count, rank of the issues of a range: ``states`` and ``days`` of
    each repository, and ``labels`` over all (repo_name is NULL there); an issue without labels
    counts in the first two only."""
    chosen = in_repos(in_range(issues, start, end), repos)
    repo, nowhere = F.col("repo_name"), F.lit(None).cast("string")
    own = F.array(
        _row("states", F.col("state"), repo_name=repo),
        _row("days", day(F.col("created_at")), repo_name=repo),
    )
    labels = F.transform("labels", lambda label: _row("labels", label, repo_name=nowhere))
    rows = F.when(F.col("labels").isNull(), own).otherwise(F.concat(own, labels))
    counted = chosen.select(F.inline(rows)).groupBy("panel", "repo_name", "key").agg(
        F.count("*").alias("count")
    )
    return _ranked(counted, top)


def panel(report: DataFrame, name: str) -> DataFrame:
    """One panel of a report."""
    return report.where(F.col("panel") == name).drop("panel")
