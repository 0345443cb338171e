"""Daily counts kept as state of a stream, and the limits and alerts that follow from them.

Rows of both feeds (events and issues) are counted by day. The state of a day holds the hashes
of the rows counted so far, so a repeated row counts once however late it comes, and the
counts. When the watermark has passed a day by ``late_by`` a timer closes it: the hashes go,
the counts stay, and later rows of that day are left out. A day is dealt into parts by the
hash of its rows, so a busy day is several keys, each with a part of its hashes.

Each batch stores the counts of the days that it changed; the newest of each part, added up,
are the daily counts. Mean and deviation over a window of days come from count, sum and sum
of squares, which can be added over any set of days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from repolume.functions import scores
from repolume.functions.timecols import AsOf, as_datetime, day, days_before, start_of_day
from repolume.operators.delivery import is_bug
from repolume.sources.tables import LOAD
from repolume.sources.thresholds import DEFAULTS
from repolume.streaming.ingest import run_available
from repolume.workers import ship

PARTS = 8  # of a day
DAY_MS = 86_400_000
COUNTS = "source string, date date, part int, n long, failing long, closed boolean"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted_rows(rows: DataFrame, source: str, failing: Column | None = None) -> DataFrame:
    """The rows of a feed (id, created_at and what ``failing`` reads), as the state needs them."""
    at = F.col("created_at").cast("timestamp")
    first, second = F.xxhash64("id", at), F.xxhash64(at, "id")
    failed = F.coalesce(failing, F.lit(False)) if failing is not None else F.lit(False)
    return rows.where(at.isNotNull()).select(
        F.lit(source).alias("source"),
        at.alias("created_at"),
        day(at).alias("date"),
        F.pmod(second, F.lit(PARTS)).cast("int").alias("part"),
        first.alias("first"),
        second.alias("second"),
        failed.alias("failing"),
    )


class DayCounts(StatefulProcessor):
    """Counts of one part of a day, each row once, until the day is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "hashes binary")
        self.counts = handle.getValueState("counts", "n long, failing long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, failing = self.counts.get() if self.counts.exists() else (0, 0)
        held = self.seen.get()[0] if self.seen.exists() else b""
        if not held:
            closes = (pd.Timestamp(key[1]).value // 1_000_000) + DAY_MS
            self.handle.registerTimer(closes)  # the watermark is late by itself
        known = {held[i : i + 16] for i in range(0, len(held), 16)}
        fresh = []
        for part in rows:
            pairs = np.stack([part["first"].to_numpy(), part["second"].to_numpy()], axis=1)
            data = pairs.astype("<i8").tobytes()
            for i, failed in enumerate(part["failing"].tolist()):
                row = data[16 * i : 16 * i + 16]
                if row not in known:
                    known.add(row)
                    fresh.append(row)
                    n, failing = n + 1, failing + bool(failed)
        self.seen.update((held + b"".join(fresh),))
        self.counts.update((n, failing))
        yield self._row(key, n, failing, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, failing = self.counts.get()
        self.seen.clear()
        yield self._row(key, n, failing, True)

    @staticmethod
    def _row(key, n: int, failing: int, closed: bool) -> pd.DataFrame:
        source, date, part = key
        return pd.DataFrame(
            {
                "source": [source],
                "date": [date],
                "part": [part],
                "n": [n],
                "failing": [failing],
                "closed": [closed],
            }
        )

    def close(self) -> None:
        pass


def stream_counts(
    rows: DataFrame, path: str, checkpoint: str, late_by_days: int = 60
) -> StreamingQuery:
    """Keep the counts of a stream of ``counted_rows`` (of one feed or both): the changed counts
    of each batch go to ``path`` under the batch's number, and a repeated batch replaces its
    own. Rows up to ``late_by_days`` behind the newest are counted, in whatever order."""
    spark = rows.sparkSession
    ship(spark)
    counts = (
        rows.withWatermark("created_at", f"{late_by_days} days")
        .groupBy("source", "date", "part")
        .transformWithStateInPandas(
            statefulProcessor=DayCounts(),
            outputStructType=COUNTS,
            outputMode="Update",
            timeMode="EventTime",
        )
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{LOAD}={batch_id}")

    held = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # timers need a store that can scan by time
    try:
        writer = counts.writeStream.outputMode("update").foreachBatch(save)
        return run_available(writer.option("checkpointLocation", checkpoint))
    finally:
        if held is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, held)


def daily_totals(versions: DataFrame) -> DataFrame:
    """source, date, n, failing, closed from the stored versions: the newest of each part (counts
    only grow), added up; a day is closed once all of its parts are."""
    newest = versions.groupBy("source", "date", "part").agg(
        F.max("n").alias("n"), F.max("failing").alias("failing"), F.max("closed").alias("closed")
    )
    return newest.groupBy("source", "date").agg(
        F.sum("n").alias("n"), F.sum("failing").alias("failing"), F.min("closed").alias("closed")
    )


def moments(days: DataFrame, *key: str) -> DataFrame:
    """count, total and squares of the days' counts: to be added over sets of days."""
    n = F.col("n").cast("decimal(38,0)")
    return days.groupBy(*key).agg(
        F.count("n").alias("days"), F.sum(n).alias("total"), F.sum(n * n).alias("squares")
    )


def three_sigma(days: Column, total: Column, squares: Column) -> Column:
    """Mean plus three standard deviations from the moments, in exact sums."""
    # days * squares - total^2 is a whole number, so nothing cancels
    spread = (days * squares - total * total).cast("double")
    return total.cast("double") / days + 3 * F.sqrt(F.greatest(spread, F.lit(0.0))) / days


def _limit(source: str, default: str) -> Column:
    of = F.col("source") == source
    parts = [F.max(F.when(of, F.col(c))) for c in ("days", "total", "squares")]
    limit = three_sigma(*parts)
    return F.coalesce(F.when(limit != 0, limit), F.lit(DEFAULTS[default]))


def _window(days: DataFrame, as_of: AsOf, look_back: int) -> DataFrame:
    """The days of the look-back; ``as_of`` and the look-back are taken as whole days."""
    return days.where(F.col("date") >= F.lit(days_before(start_of_day(as_of), look_back).date()))


def limits_from_days(days: DataFrame, as_of: AsOf, look_back: int = 90) -> DataFrame:
    """``dynamic_thresholds`` from the daily counts, without reading a row of the feeds."""
    sums = moments(_window(days, as_of, look_back), "source")
    fixed = ("cfr_threshold", "mttr_threshold", "lead_time_threshold")
    return sums.agg(
        _limit("events", "events_per_day").alias("events_per_day"),
        _limit("issues", "issues_per_day").alias("issues_per_day"),
    ).select("*", *(F.lit(DEFAULTS[name]).alias(name) for name in fixed))


def health_from_days(
    days: DataFrame,
    as_of: AsOf,
    look_back: int = 90,
    cfr_threshold: float = DEFAULTS["cfr_threshold"],
) -> DataFrame:
    """``system_health`` from the daily counts, with the counts so far of the day of ``as_of``
    and later."""
    today = F.col("date") >= F.lit(as_datetime(as_of).date())
    now = _window(days, as_of, look_back).withColumn("now", today)
    rows = now.groupBy("source").agg(
        F.count("n").alias("days"),
        F.sum(F.col("n").cast("decimal(38,0)")).alias("total"),
        F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("squares"),
        F.coalesce(F.sum(F.when(F.col("now"), F.col("n"))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(F.col("now"), F.col("failing"))), F.lit(0)).alias("failing"),
    )
    limit = three_sigma(F.col("days"), F.col("total"), F.col("squares"))
    current = F.col("current").cast("double")
    rate = F.coalesce(scores.percent(F.col("failing"), F.col("current")), F.lit(0.0))

    def row(metric: str, value: Column, threshold: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            value.alias("current"),
            threshold.alias("threshold"),
            scores.health_status(value, threshold).alias("status"),
        )

    events = F.array(
        row("Events", current, limit),
        row("Change Failure Rate", rate, F.lit(float(cfr_threshold))),
    )
    issues = F.array(row("Issues", current, limit))
    return rows.select(F.inline(F.when(F.col("source") == "events", events).otherwise(issues)))


def alerts_from_days(days: DataFrame, as_of: AsOf, look_back: int = 90) -> DataFrame:
    """``daily_anomalies`` of all repositories from the daily counts of the events: each day of
    the feed beside the limit of the look-back."""
    events = days.where("source = 'events' AND n > 0")
    inside = F.col("date") >= F.lit(days_before(start_of_day(as_of), look_back).date())
    # one row per day by now
    every = Window.partitionBy(F.lit(0))
    n = F.when(inside, F.col("n").cast("decimal(20,0)"))
    limit = three_sigma(
        F.count(n).over(every), F.sum(n).over(every), F.sum((n * n).cast("decimal(38,0)")).over(every)
    )
    line = F.coalesce(F.when(limit != 0, limit), F.lit(DEFAULTS["events_per_day"]))
    return events.select(
        F.col("date").alias("time"), F.col("n").alias("events"), line.alias("threshold")
    ).withColumn("is_anomaly", F.col("events") > F.col("threshold"))


def event_rows(events: DataFrame) -> DataFrame:
    return counted_rows(events, "events", is_bug(events))


def issue_rows(issues: DataFrame) -> DataFrame:
    return counted_rows(issues, "issues")
