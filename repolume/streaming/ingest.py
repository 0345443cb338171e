"""Structured Streaming jobs over landed files.

All run to the end of what has landed and stop; a scheduler starts them again.
Outputs are written per batch under the batch's number, so a batch repeated
after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolume.functions.timecols import day, month_key
from repolume.sources.feeds import EVENT_COLUMNS, EVENT_KEY, dedup_events, parse_events
from repolume.sources.tables import LOAD, MONTH, append_events, table_exists
from repolume.streaming.rollup import append_delta, rollup_delta


def run_available(writer) -> StreamingQuery:
    """Process what has landed, then stop; a failure is raised."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_ingest(
    spark: SparkSession,
    landing: str,
    events_path: str,
    rollup_path: str,
    rejected_path: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    once: bool = False,
) -> StreamingQuery:
    """Load landed feed files: good rows to the event table, their delta to the
    rollup, bad rows with the reason to their own table.

    Repeated events are loaded again, as the feed gives them. With ``once`` an event
    that is stored already, or comes again, goes neither to the table nor to the rollup,
    so a feed that is read again every hour counts once.
    """
    feed = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)

    def load(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_events(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = parsed.where("error IS NULL").select(*EVENT_COLUMNS)
            if once:
                append_events(new_events(good, events_path, batch_id), events_path, batch_id)
                # what was stored is read back, so that both tables agree
                good = _load_of(spark, events_path, batch_id, good)
            else:
                append_events(good, events_path, load_id=batch_id)
            append_delta(rollup_delta(good), rollup_path, load_id=batch_id)
            bad = parsed.where("error IS NOT NULL").select("value", "error")
            (
                bad.withColumn(LOAD, F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(LOAD)
                .parquet(rejected_path)
            )
        finally:
            parsed.unpersist()

    writer = feed.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return run_available(writer)


def daily_counts(events: DataFrame, late_by: str | None = None) -> DataFrame:
    """Streamed events per day, repository and type.

    As it stands every late event is counted, and the state is as large as the
    result. ``late_by`` bounds it: days that far behind the newest event are
    forgotten, and events for them left out. The rollup needs no such bound.
    """
    if late_by is not None:
        events = events.withWatermark("created_at", late_by)
    return (
        events.groupBy(
            F.window("created_at", "1 day").alias("day"),
            "repo_name",
            F.col("type").alias("event_type"),
        )
        .agg(F.count("*").alias("event_count"))
        .select(
            F.to_date("day.start").alias("date"), "repo_name", "event_type", "event_count"
        )
    )


def stream_daily_counts(
    events: DataFrame, path: str, checkpoint: str, late_by: str | None = None
) -> StreamingQuery:
    """Write each batch's changed counts under the batch's number."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/load_id={batch_id}")

    writer = (
        daily_counts(events, late_by)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
    )
    return run_available(writer)


def latest_daily_counts(versions: DataFrame) -> DataFrame:
    """The newest count of each day, repository and type; counts only grow."""
    return versions.groupBy("date", "repo_name", "event_type").agg(
        F.max("event_count").alias("event_count")
    )


def collapse_daily_counts(spark: SparkSession, path: str, target: str) -> None:
    """The newest counts of all versions at ``path``, as a table of their own."""
    latest_daily_counts(spark.read.parquet(path)).write.mode("overwrite").parquet(target)


def _days(rows: DataFrame) -> DataFrame:
    return rows.select(
        month_key(F.col("created_at")).alias(MONTH), day(F.col("created_at")).alias("_day")
    ).distinct()


def new_events(batch: DataFrame, path: str, load_id: int) -> DataFrame:
    """The events of a batch that the table does not hold yet, each once.

    Copies of an event have its id and its time (``EVENT_KEY``; an id that comes with another
    time is another event, here and in ``dedup_events``), so only stored rows of the batch's
    own days are compared, and of them only the key is read, in the days' months. A repeated
    load is not compared with its own rows, which it replaces.
    """
    spark = batch.sparkSession
    new = dedup_events(batch)
    if not table_exists(spark, path):
        return new
    days = _days(batch)
    months = [r[0] for r in days.select(MONTH).distinct().collect()]  # a few for each batch
    stored = spark.read.parquet(path).where(
        F.col(MONTH).isin(months) & (F.col(LOAD) != load_id)
    )
    held = (
        stored.withColumn("_day", day(F.col("created_at")))
        .join(days.select("_day"), "_day", "left_semi")
        .select(*EVENT_KEY)
    )
    return new.join(held, list(EVENT_KEY), "left_anti")


def _load_of(spark: SparkSession, path: str, load_id: int, like: DataFrame) -> DataFrame:
    """The stored rows of one load; none if it stored nothing."""
    if not table_exists(spark, path):
        return like.limit(0)
    return spark.read.parquet(path).where(F.col(LOAD) == load_id).select(*like.columns)


def append_new_events(batch: DataFrame, path: str, load_id: int) -> None:
    """Append the events that the table does not hold yet, each once."""
    append_events(new_events(batch, path, load_id), path, load_id=load_id)


def stream_dedup(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each streamed event once, however often and late it is repeated."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            append_new_events(rows, path, batch_id)
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return run_available(writer)
