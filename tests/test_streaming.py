import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from repolume.sources.feeds import EVENT_COLUMNS, dedup_events, normalize_events
from repolume.sources.tables import append_events
from repolume.streaming import ingest, rollup


def feed_line(i, actor=None, when=None):
    when = when or datetime(2024, 1, 1) + timedelta(hours=i)
    return json.dumps(
        {
            "id": str(i),
            "type": ["PushEvent", "ForkEvent"][i % 2],
            "actor": {"login": actor or f"a{i % 5}"},
            "repo": {"name": f"o/r{i % 3}"},
            "created_at": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
            "payload": {},
        }
    )


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def paths(tmp_path):
    return [str(tmp_path / p) for p in ("events", "rollup", "rejected", "checkpoint")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ingest_over_several_runs_equals_one_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    lines = [feed_line(i) for i in range(90)]
    for n in range(3):
        land(landing, f"{n}.json", lines[n * 30:(n + 1) * 30] + ["{bad"])
        ingest.stream_ingest(spark, str(landing), *paths(tmp_path), files_per_batch=1)
    events, deltas, rejected = (spark.read.parquet(p) for p in paths(tmp_path)[:3])
    whole = normalize_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(events.select(*EVENT_COLUMNS)) == rows(whole)
    assert rejected.count() == 3
    batch = rollup.rollup_delta(whole).select(*rollup.KEY, "event_count", "unique_users")
    assert rows(rollup.merged_rollup(deltas)) == rows(batch)


def test_nothing_new_is_a_no_op(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "0.json", [feed_line(i) for i in range(5)])
    for _ in range(2):
        ingest.stream_ingest(spark, str(landing), *paths(tmp_path))
    assert spark.read.parquet(paths(tmp_path)[0]).count() == 5


def events(spark, ids, actor=lambda i: f"a{i % 5}"):
    lines = [feed_line(i, actor(i)) for i in ids]
    return normalize_events(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_summed_users_count_twice_and_merged_once(spark, tmp_path):
    path = str(tmp_path / "rollup")
    day_events = events(spark, range(20), lambda i: "one").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )
    for load in (0, 1):
        delta = rollup.rollup_delta(day_events.where(F.col("id").cast("int") % 2 == load))
        rollup.append_delta(delta, path, load)
    table = spark.read.parquet(path)
    totals = rollup.summed_rollup(table.withColumn("event_type", F.lit("all")))
    assert totals.agg(F.sum("event_count")).first()[0] == 20
    assert {r["unique_users"] for r in totals.collect()} == {2}
    merged = rollup.merged_rollup(table.withColumn("event_type", F.lit("all")))
    assert {r["unique_users"] for r in merged.collect()} == {1}


def test_a_repeated_delta_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "rollup")
    for _ in range(3):
        rollup.append_delta(rollup.rollup_delta(events(spark, range(10))), path, 7)
    assert spark.read.parquet(path).agg(F.sum("event_count")).first()[0] == 10


def test_sketch_error_is_small_for_many_users(spark):
    many = spark.range(60000).select(
        F.col("id").cast("string").alias("id"),
        F.lit("PushEvent").alias("type"),
        F.concat(F.lit("u"), F.col("id") % 30000).alias("actor_login"),
        F.lit("o/r").alias("repo_name"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        (F.col("id") % 3).alias("load_id"),
    )
    deltas = rollup.rollup_delta(many, "load_id")
    found = rollup.merged_rollup(deltas).first()
    assert found["event_count"] == 60000
    assert abs(found["unique_users"] - 30000) < 0.05 * 30000
    collapsed = rollup.merged_rollup(rollup.collapse_rollup(deltas)).first()
    assert collapsed == found


def test_dedup_of_a_double_load_equals_one_load(spark, tmp_path):
    path = str(tmp_path / "events")
    once = events(spark, range(40))
    for _ in range(2):
        append_events(once, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 80
    assert rows(dedup_events(stored).select(*EVENT_COLUMNS)) == rows(once)


def test_stream_dedup_across_runs(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    checkpoint = str(tmp_path / "cp")
    for ids in (range(0, 30), range(20, 50), range(0, 50)):
        events(spark, ids).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, [0]).schema).parquet(source)
        ingest.stream_dedup(stream, target, checkpoint)
    assert rows(spark.read.parquet(target).select(*EVENT_COLUMNS)) == rows(events(spark, range(50)))


def test_stream_counts_over_runs_with_late_rows(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    checkpoint = str(tmp_path / "cp")
    for ids in (range(40, 80), range(0, 40), range(80, 100)):
        events(spark, ids).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, [0]).schema).parquet(source)
        ingest.stream_daily_counts(stream, target, checkpoint)
    found = ingest.latest_daily_counts(spark.read.parquet(target))
    whole = events(spark, range(100)).groupBy(
        F.to_date("created_at").alias("date"), "repo_name", F.col("type").alias("event_type")
    ).agg(F.count("*").alias("event_count"))
    assert rows(found) == rows(whole)


def test_a_feed_landed_three_times_counts_once(spark, tmp_path):
    landing = tmp_path / "landing"
    lines = [feed_line(i) for i in range(60)]
    # the hourly job reads the last day again: the same events at other times, and in one batch
    for n, part in enumerate((lines[:40], lines[10:] + lines[:3], lines + lines, lines)):
        land(landing, f"{n}.json", part)
        ingest.stream_ingest(spark, str(landing), *paths(tmp_path), once=True)
    events_path, rollup_path = paths(tmp_path)[:2]
    whole = normalize_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(spark.read.parquet(events_path).select(*EVENT_COLUMNS)) == rows(whole)
    batch = rollup.rollup_delta(whole).select(*rollup.KEY, "event_count", "unique_users")
    assert rows(rollup.merged_rollup(spark.read.parquet(rollup_path))) == rows(batch)


def test_stream_and_batch_agree_on_what_an_event_is(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    once = events(spark, range(4))
    moved = once.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    parts = (once, once.unionByName(moved), moved)
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(once.schema).parquet(source)
        ingest.stream_dedup(stream, target, str(tmp_path / "cp"))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(spark.read.parquet(target).select(*EVENT_COLUMNS)) == rows(
        dedup_events(both).select(*EVENT_COLUMNS)
    )


def test_a_late_event_widens_the_look_up_by_its_day_only(spark, tmp_path):
    path = str(tmp_path / "events")
    append_events(events(spark, range(24 * 60)), path, load_id=0)
    batch = events(spark, [0, 24 * 50, 24 * 70])
    new = ingest.new_events(batch, path, 1)
    assert [r["id"] for r in new.collect()] == [str(24 * 70)]
    plan = new._jdf.queryExecution().executedPlan().toString()
    stored = [line for line in plan.split("\n") if "PartitionFilters: [" in line and "load_id" in line]
    assert stored and "202401" in stored[0] and "202402" in stored[0]
