"""Loads that look back, for each repository, to its own high-water mark.

A load is a set of fetched pages, each with the repository that was asked for. A repository
whose pages could not all be read is held back: nothing of it is stored, its mark stays, and
the next fetch closes its gap alone. Marks are written after the events are stored, under the
number of the load, so that a load repeated after a failure replaces its own rows of both.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, days_before
from repolume.sources.feeds import EVENT_COLUMNS, parse_events
from repolume.sources.tables import LOAD, table_exists
from repolume.streaming.ingest import append_new_events

# One row for each repository and load; the mark is NULL where the repository was held back.
LOG = "repo_name string, loaded bigint, rejected bigint, mark timestamp, load_id bigint"
# Without a mark a fetch goes back as far as this; with one, it repeats its last hour, as
# some events reach the feed late.
DAYS_BACK, OVERLAP_HOURS = 7, 1


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """What each load did for each repository."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def marks(spark: SparkSession, path: str, but_load: int | None = None) -> DataFrame:
    """repo_name and mark, the time of the newest event stored by any load (``but_load`` left
    out), of every repository that has one."""
    log = load_log(spark, path).where("mark IS NOT NULL")
    if but_load is not None:
        log = log.where(F.col(LOAD) != but_load)
    return log.groupBy("repo_name").agg(F.max("mark").alias("mark"))


def _since(as_of: AsOf, days_back: int, overlap_hours: int) -> Column:
    first = F.lit(days_before(as_of, days_back)).cast("timestamp")
    return F.coalesce(F.col("mark") - F.make_dt_interval(hours=F.lit(overlap_hours)), first)


def next_fetches(
    repos: DataFrame,
    marks_path: str,
    as_of: AsOf,
    days_back: int = DAYS_BACK,
    overlap_hours: int = OVERLAP_HOURS,
) -> DataFrame:
    """repo_name and ``since``, from when to fetch each repository (first column of ``repos``)."""
    wanted = repos.select(F.col(repos.columns[0]).alias("repo_name")).distinct()
    known = marks(repos.sparkSession, marks_path)
    since = _since(as_of, days_back, overlap_hours).alias("since")
    return wanted.join(known, "repo_name", "left").select("repo_name", since)


def load_fetches(
    fetches: DataFrame,
    events_path: str,
    marks_path: str,
    load_id: int,
    as_of: AsOf,
    days_back: int = DAYS_BACK,
    overlap_hours: int = OVERLAP_HOURS,
) -> DataFrame:
    """Store the events of fetched pages (``repo_name`` that was asked for, ``value``), each
    once, move the marks, and return this load's rows of the log.

    Of each repository the events from its mark on are taken. One with a row that cannot be
    read (a NULL ``value`` stands for a page that could not be fetched) is held back. An empty
    page is no failure, and moves no mark.
    """
    spark = fetches.sparkSession
    asked = fetches.select(F.col("repo_name").alias("asked"), "value")
    parsed = parse_events(asked, "asked").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good, bad = F.col("error").isNull(), F.col("error").isNotNull()
        outcome = parsed.groupBy("asked").agg(
            F.count_if(bad).alias("rejected"),
            F.max(F.when(good, F.col("created_at"))).alias("newest"),
        )
        known = marks(spark, marks_path, but_load=load_id).withColumnRenamed("repo_name", "asked")
        since = _since(as_of, days_back, overlap_hours)
        taken = outcome.where("rejected = 0").join(known, "asked", "left").select(
            "asked", since.alias("since")
        )
        rows = parsed.where(good).join(taken, "asked").where("created_at >= since")
        append_new_events(rows.select(*EVENT_COLUMNS), events_path, load_id)

        loaded = rows.groupBy("asked").agg(F.count("*").alias("loaded"))
        log = outcome.join(loaded, "asked", "left").select(
            F.col("asked").alias("repo_name"),
            F.coalesce("loaded", F.lit(0)).alias("loaded"),
            "rejected",
            F.when(F.col("rejected") == 0, F.col("newest")).alias("mark"),
        )
        log.write.mode("overwrite").parquet(f"{marks_path}/{LOAD}={load_id}")
    finally:
        parsed.unpersist()
    return load_log(spark, marks_path).where(F.col(LOAD) == load_id)
