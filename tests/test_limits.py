import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolume.operators import anomalies
from repolume.sources.thresholds import DEFAULTS
from repolume.streaming import limits

AS_OF = "2024-03-01 00:00:00"
TODAY = "2024-02-29 23:59:59"


def events(spark, seed, count):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        at = datetime(2024, 3, 1) - timedelta(seconds=rng.randrange(1, 40 * 86400))
        if rng.random() < 0.3:
            at = at.replace(month=2, day=10)  # a day that stands out
        rows.append((str(i), at, rng.choice(['{"a":"bug"}', "{}"])))
    return spark.createDataFrame(rows, "id string, created_at timestamp, payload string")


def counted(spark, folder, batches, late_by_days=60):
    """The daily counts after a stream has read the batches, one after the other."""
    landing, out, checkpoint = (f"{folder}/{n}" for n in ("landing", "counts", "checkpoint"))
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(f"{landing}/part={i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{landing}/part=*")
        limits.stream_counts(stream, out, checkpoint, late_by_days)
    return limits.daily_totals(spark.read.parquet(out))


def values(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()
    )


def test_any_order_and_repeats_give_the_batch_result(spark, tmp_path):
    data, issues = events(spark, 1, 500), events(spark, 2, 60)
    rows = limits.event_rows(data).unionByName(limits.issue_rows(issues))
    late = rows.where("date < '2024-02-12'")
    batches = [rows.where("date >= '2024-02-12'"), late, rows.where("part % 2 = 0"), late]
    days = counted(spark, str(tmp_path), batches)
    assert days.agg(F.sum("n")).first()[0] == 560
    assert values(limits.limits_from_days(days, AS_OF)) == values(
        anomalies.dynamic_thresholds(data, issues, AS_OF)
    )
    assert values(limits.health_from_days(days, TODAY)) == values(
        anomalies.system_health(data, issues, TODAY)
    )
    alerts = limits.alerts_from_days(days, AS_OF)
    assert values(alerts) == values(anomalies.daily_anomalies(data, AS_OF))
    assert alerts.where("is_anomaly").count() == 1
    # a shorter look-back takes the days in it
    assert values(limits.limits_from_days(days, AS_OF, 14)) == values(
        anomalies.dynamic_thresholds(data, issues, AS_OF, 14)
    )


def test_a_day_closes_and_takes_no_more_rows(spark, tmp_path):
    data = limits.event_rows(events(spark, 3, 200))
    old, new = data.where("date < '2024-02-05'"), data.where("date >= '2024-02-20'")
    again = old.withColumns({"first": F.col("first") + 1, "second": F.col("second") + 1})
    days = counted(spark, str(tmp_path), [old, new, again], late_by_days=5)
    found = {r.date.isoformat(): r for r in days.collect()}
    counts = {r["date"].isoformat(): r["count"] for r in data.groupBy("date").count().collect()}
    assert found.keys() == {day for day in counts if day < "2024-02-05" or day >= "2024-02-20"}
    for day, row in found.items():
        assert row.n == counts[day]
        # the newest row is of the 29th, so the watermark stands on the 24th
        assert row.closed == (day < "2024-02-24"), day


def test_moments_can_be_added(spark):
    days = spark.createDataFrame([("a", 3), ("a", 5), ("b", 9), ("b", 4)], "k string, n long")
    parts = limits.moments(days, "k")
    whole = parts.agg(*(F.sum(c).alias(c) for c in ("days", "total", "squares")))
    limit = limits.three_sigma(F.col("days"), F.col("total"), F.col("squares"))
    want = days.agg(F.avg("n") + 3 * F.stddev_pop("n")).first()[0]
    assert whole.select(limit).first()[0] == pytest.approx(want)


def test_nothing_counted_gives_the_defaults(spark):
    days = spark.createDataFrame([], "source string, date date, n long, failing long, closed boolean")
    row = limits.limits_from_days(days, AS_OF).first().asDict()
    assert row == {k: DEFAULTS[k] for k in row}
    assert limits.alerts_from_days(days, AS_OF).collect() == []
