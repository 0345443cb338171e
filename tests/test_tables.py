import glob
import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from repolume import schema
from repolume.functions.timecols import last_days
from repolume.sources import sqlentry, tables, thresholds

AS_OF = "2024-04-15 12:00:00"


def events(spark, n=200, start=datetime(2023, 12, 1), step=timedelta(hours=20)):
    rows = [
        (str(i), "PushEvent", f"a{i % 7}", f"o/r{i % 3}", start + i * step, "{}", None)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "id string, type string, actor_login string, repo_name string, "
        "created_at timestamp, payload string, org_login string",
    )


def ids(df):
    return sorted(int(r["id"]) for r in df.select("id").collect())


def test_append_fills_month_and_load_time(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(events(spark), path, backfill=True)
    tables.append_events(events(spark, 3), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 203
    assert stored.where("_inserted_at IS NULL").count() == 0
    assert stored.where("event_month <> year(created_at) * 100 + month(created_at)").count() == 0


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(events(spark, 50), path, load_id=0)
    for _ in range(2):
        tables.append_events(events(spark, 100).where("CAST(id AS INT) >= 50"), path, load_id=1)
    assert ids(spark.read.parquet(path)) == list(range(100))


@pytest.mark.parametrize("load_id", [None, 3])
def test_files_are_sorted_by_time(spark, tmp_path, load_id):
    path = str(tmp_path / "events")
    tables.append_events(events(spark, 5000, step=timedelta(minutes=30)).orderBy(F.rand(1)), path, load_id)
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        times = pq.read_table(file, columns=["created_at"])["created_at"].to_pylist()
        assert times == sorted(times)


def test_look_back_prunes_months(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(events(spark), path)
    plan = last_days(spark.read.parquet(path), AS_OF, 30)._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_month" in filters and "202403" in filters


@pytest.mark.parametrize("load_ids", [None, [0, 1]])
def test_retention_in_place(spark, tmp_path, load_ids):
    path = str(tmp_path / "events")
    data = events(spark)
    for load in load_ids or [None]:
        part = data if load is None else data.where(F.col("id").cast("int") % 2 == load)
        tables.append_events(part, path, load_id=load)
    expected = ids(tables.retention_keep(data, AS_OF))
    tables.apply_retention(spark, path, AS_OF)
    assert ids(spark.read.parquet(path)) == expected
    assert 0 < len(expected) < 200
    months = [os.path.basename(p) for p in glob.glob(f"{path}/event_month=*")]
    assert min(months) == "event_month=202401"


def test_retention_drops_a_load_whose_rows_all_expired(spark, tmp_path):
    path = str(tmp_path / "events")
    data = events(spark, 62, datetime(2024, 1, 1), timedelta(hours=12))
    old = F.col("created_at") < F.lit("2024-01-10").cast("timestamp")
    tables.append_events(data.where(old), path, load_id=0)
    tables.append_events(data.where(~old), path, load_id=1)
    tables.apply_retention(spark, path, AS_OF)
    assert ids(spark.read.parquet(path)) == ids(tables.retention_keep(data, AS_OF))


def test_delete_keeps_rows_with_an_unknown_condition(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "repo_name string")
    assert tables.delete_rows(df, F.col("repo_name") == "a").count() == 2


def test_compaction_keeps_rows_and_merges_files(spark, tmp_path):
    path, target = str(tmp_path / "events"), str(tmp_path / "compact")
    data = events(spark)
    for load in range(6):
        tables.append_events(data.where(F.col("id").cast("int") % 6 == load), path, load_id=load)
    tables.compact_events(spark, path, target)
    before = len(glob.glob(f"{path}/**/*.parquet", recursive=True))
    after = len(glob.glob(f"{target}/**/*.parquet", recursive=True))
    assert ids(spark.read.parquet(target)) == list(range(200))
    assert after < before and after <= 7


def test_a_load_can_follow_a_compaction(spark, tmp_path):
    path, target = str(tmp_path / "events"), str(tmp_path / "compact")
    for load in range(2):
        part = events(spark, 60).where(F.col("id").cast("int") % 2 == load)
        tables.append_events(part, path, load_id=load)
    tables.compact_events(spark, path, target)
    tables.append_events(events(spark, 70).where("CAST(id AS INT) >= 60"), target, load_id=2)
    stored = spark.read.parquet(target)
    assert ids(stored) == list(range(70))
    assert {r[0] for r in stored.select("load_id").distinct().collect()} == {-1, 2}


def test_compaction_splits_a_big_month(spark, tmp_path):
    path, target = str(tmp_path / "events"), str(tmp_path / "compact")
    data = events(spark, 20000, datetime(2024, 1, 1), timedelta(minutes=1))
    tables.append_events(data, path)
    size = tables.table_sizes(spark, {"events": path}).first()["bytes"]
    tables.compact_events(spark, path, target, file_bytes=size // 4)
    files = glob.glob(f"{target}/event_month=202401/*.parquet")
    assert len(files) >= 4
    spans = sorted(
        tuple(spark.read.parquet(f).agg(F.min("created_at"), F.max("created_at")).first())
        for f in files
    )
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("in_place", [False, True])
def test_compaction_sorts_bounded_pieces(spark, tmp_path, monkeypatch, in_place):
    """One file of several pieces, none of which has more rows than a task may sort."""
    path, target = str(tmp_path / "events"), str(tmp_path / "compact")
    monkeypatch.setattr(tables, "PIECE_ROWS", 500)
    data = events(spark, 4000, datetime(2024, 1, 1), timedelta(minutes=1))
    for load in range(6):
        tables.append_events(part_of(data, load, 6), path, load_id=load)
    sorted_rows = []
    groups = tables._file_groups

    def noted(spark, at, file_bytes):
        found = groups(spark, at, file_bytes)
        for _, several in found:
            sorted_rows.extend(spark.read.parquet(f).count() for g in several for f in g)
        return found

    monkeypatch.setattr(tables, "_file_groups", noted)
    if in_place:
        assert tables.compact_in_place(spark, path, str(tmp_path / "staging")) == [202401]
        assert tables.compact_in_place(spark, path, str(tmp_path / "staging")) == []
        target = path
    else:
        tables.compact_events(spark, path, target)
    (file,) = glob.glob(f"{target}/event_month=202401/load_id=-1/*.parquet")
    times = [r[0] for r in spark.read.parquet(file).coalesce(1).select("created_at").collect()]
    assert times == sorted(times) and ids(spark.read.parquet(target)) == list(range(4000))
    assert len(sorted_rows) >= 8 and max(sorted_rows) < 1500
    assert not glob.glob(f"{target}/_staging")


def test_sizes_equal_the_files(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(events(spark), path)
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    row = tables.table_sizes(spark, {"events": path}).first()
    data_files = [f for f in glob.glob(f"{path}/**/*", recursive=True)
                  if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]
    assert len(files) == len(data_files) == row["files"]
    assert row["bytes"] == sum(os.path.getsize(f) for f in files)


def test_export_replaces_and_skips_an_empty_table(spark, tmp_path):
    target = str(tmp_path / "out")
    assert tables.export_table(events(spark, 5), target, "json")
    assert tables.export_table(events(spark, 3), target, "json")
    assert not tables.export_table(events(spark, 0), target, "json")
    assert spark.read.json(target).count() == 3


def test_backup_restore_and_expiry(spark, tmp_path):
    folder, path = str(tmp_path / "backups"), str(tmp_path / "events")
    source = events(spark, 20)
    old = tables.backup_table(source, folder, "2024-01-01 02:00:00")
    new = tables.backup_table(source, folder, "2024-02-10 02:00:00")
    assert tables.remove_expired_backups(spark, folder, "2024-02-15") == [os.path.basename(old)]
    tables.restore_table(spark, new, path)
    assert ids(spark.read.parquet(path)) == list(range(20))


def test_thresholds(spark, tmp_path):
    path = str(tmp_path / "thresholds")
    assert thresholds.load_thresholds(spark, path).first().asDict() == thresholds.DEFAULTS
    partial = spark.sql("SELECT 250.5D AS events_per_day, 'text' AS method")
    thresholds.save_thresholds(partial, path)
    stamped = thresholds.with_stamp(thresholds.default_thresholds(spark), "2024-01-31")
    assert stamped.first()["last_updated"] == "2024-01-31T00:00:00+00:00"
    loaded = thresholds.load_thresholds(spark, path).first().asDict()
    assert loaded == {**thresholds.DEFAULTS, "events_per_day": 250.5}


def test_create_tables(spark):
    names = schema.create_tables(spark, "activity_test")
    assert len(names) == len(schema.TABLES)
    schema.create_tables(spark, "activity_test")
    created = spark.table("activity_test.events")
    assert created.columns == [f.name for f in schema.EVENTS.fields] + ["event_month", "load_id"]
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP DATABASE activity_test")


def test_sql_entry_keeps_columns_of_an_empty_result(spark):
    df = sqlentry.query(
        spark,
        "SELECT id FROM {e} WHERE repo_name = :repo",
        {"repo": "it's not there"},
        {"e": events(spark, 5)},
    )
    assert df.columns == ["id"] and df.count() == 0
    with pytest.raises(Exception):
        sqlentry.query(spark, "SELECT nothing FROM {e}", tables={"e": events(spark, 1)})


def loaded(spark, path, loads=3, n=60):
    for load in range(loads):
        part = events(spark, n).where(F.col("id").cast("int") % loads == load)
        tables.append_events(part, path, load_id=load)


def test_restore_of_a_table_kept_by_load(spark, tmp_path):
    path, folder, target = (str(tmp_path / p) for p in ("events", "backups", "restored"))
    loaded(spark, path)
    backup = tables.backup_table(spark.read.parquet(path), folder, AS_OF, path)
    with pytest.raises(ValueError):
        tables.backup_table(spark.read.parquet(path), folder, AS_OF)
    with pytest.raises(FileExistsError):
        tables.backup_table(spark.read.parquet(path), folder, AS_OF, path)
    for where in (target, target, path):  # a new place, twice, and the table itself
        tables.restore_table(spark, backup, where)
        stored = spark.read.parquet(where)
        assert ids(stored) == list(range(60))
        assert {r[0] for r in stored.select("load_id").distinct().collect()} == {0, 1, 2}
    # loads go on there, repeated ones and new ones
    tables.append_events(events(spark, 60).where("CAST(id AS INT) % 3 = 1"), target, load_id=1)
    tables.append_events(events(spark, 70).where("CAST(id AS INT) >= 60"), target, load_id=3)
    assert ids(spark.read.parquet(target)) == list(range(70))


def test_restore_of_a_backup_without_loads_into_a_table_kept_by_load(spark, tmp_path):
    path, folder, plain = (str(tmp_path / p) for p in ("events", "backups", "plain"))
    loaded(spark, path, n=30)
    tables.append_events(events(spark, 40).where("CAST(id AS INT) >= 30"), plain)
    backup = tables.backup_table(spark.read.parquet(plain), folder, AS_OF)
    for _ in range(2):
        tables.restore_table(spark, backup, path)
    assert ids(spark.read.parquet(path)) == list(range(40))


def crowded(spark, path, loads=8):
    data = events(spark, 80, step=timedelta(hours=6))  # one month
    for load in range(loads):
        part = data.where(F.col("id").cast("int") % loads == load)
        tables.append_events(part, path, load_id=load)
    return data


def test_a_load_repeated_after_compaction_doubles_nothing(spark, tmp_path):
    path, staging = str(tmp_path / "events"), str(tmp_path / "staging")
    data = crowded(spark, path)
    assert tables.compact_in_place(spark, path, staging) == [202312]
    assert tables.compact_in_place(spark, path, staging) == []
    assert ids(spark.read.parquet(path)) == list(range(80))
    assert len(glob.glob(f"{path}/event_month=202312/*/*.parquet")) == 1
    for load in (0, 5):
        tables.append_events(data.where(F.col("id").cast("int") % 8 == load), path, load_id=load)
    assert ids(spark.read.parquet(path)) == list(range(80))
    more = events(spark, 90, step=timedelta(hours=6)).where("CAST(id AS INT) >= 80")
    tables.append_events(more, path, load_id=8)
    assert ids(spark.read.parquet(path)) == list(range(90))


def part_of(data, load, loads=8):
    return data.where(F.col("id").cast("int") % loads == load)


@pytest.mark.parametrize("first_in_place", [False, True])
def test_a_load_repeated_after_compaction_to_a_new_place(spark, tmp_path, first_in_place):
    path, staging, target = (str(tmp_path / p) for p in ("events", "staging", "target"))
    data = crowded(spark, path)
    if first_in_place:
        tables.compact_in_place(spark, path, staging)
    tables.compact_events(spark, path, target)
    with pytest.raises(FileExistsError):
        tables.compact_events(spark, path, target)
    for load in (0, 7):
        tables.append_events(part_of(data, load), target, load_id=load)
    assert ids(spark.read.parquet(target)) == list(range(80))
    # and after a compaction in place there
    for load in range(20, 28):
        more = events(spark, 100, step=timedelta(hours=6)).where(f"CAST(id AS INT) = {60 + load}")
        tables.append_events(more, target, load_id=load)
    assert tables.compact_in_place(spark, target, staging) == [202312]
    for load in (0, 22):
        tables.append_events(part_of(data, load % 8), target, load_id=load)
    assert ids(spark.read.parquet(target)) == list(range(88))


def test_compact_backup_restore_replay(spark, tmp_path):
    path, staging, folder = (str(tmp_path / p) for p in ("events", "staging", "backups"))
    data = crowded(spark, path)
    plain = str(tmp_path / "plain")
    crowded(spark, plain)
    single = tables.backup_table(spark.read.parquet(plain), folder, "2024-01-01", plain)
    tables.compact_in_place(spark, path, staging)
    merged = tables.backup_table(spark.read.parquet(path), folder, "2024-01-02", path)
    new = str(tmp_path / "new")
    # merged rows to a new place, over single loads; single loads over merged rows
    for backup, where in ((merged, new), (merged, plain), (single, path)):
        for _ in range(2):
            tables.restore_table(spark, backup, where)
        assert ids(spark.read.parquet(where)) == list(range(80))
        for load in (0, 5):
            tables.append_events(part_of(data, load), where, load_id=load)
        assert ids(spark.read.parquet(where)) == list(range(80))


def test_restore_does_not_lose_loads_that_were_merged_since(spark, tmp_path):
    path, staging, folder = (str(tmp_path / p) for p in ("events", "staging", "backups"))
    crowded(spark, path)
    tables.compact_in_place(spark, path, staging)
    backup = tables.backup_table(spark.read.parquet(path), folder, AS_OF, path)
    for load in range(8, 16):
        more = events(spark, 96, step=timedelta(hours=6)).where(f"CAST(id AS INT) = {72 + load}")
        tables.append_events(more, path, load_id=load)
    tables.compact_in_place(spark, path, staging)  # under another number
    tables.restore_table(spark, backup, path)
    assert ids(spark.read.parquet(path)) == list(range(88))


def test_a_second_compaction_merges_the_first(spark, tmp_path):
    path, staging = str(tmp_path / "events"), str(tmp_path / "staging")
    crowded(spark, path)
    tables.compact_in_place(spark, path, staging)
    for load in range(8, 16):
        part = events(spark, 96, step=timedelta(hours=6)).where(f"CAST(id AS INT) = {72 + load}")
        tables.append_events(part, path, load_id=load)
    assert tables.compact_in_place(spark, path, staging) == [202312]
    stored = spark.read.parquet(path)
    assert ids(stored) == list(range(88))
    assert {r[0] for r in stored.select("load_id").distinct().collect()} == {-2}


def test_compaction_that_was_cut_off_is_mended(spark, tmp_path, monkeypatch):
    path, staging = str(tmp_path / "events"), str(tmp_path / "staging")
    data = crowded(spark, path)

    def crash(*_):
        raise OSError("lost")

    # after the merged rows are in place, before the loads are removed
    with monkeypatch.context() as m:
        m.setattr(tables, "delete_folder", crash)
        with pytest.raises(OSError):
            tables.compact_in_place(spark, path, staging)
    tables.compact_in_place(spark, path, staging)
    assert ids(spark.read.parquet(path)) == list(range(80))
    # before the merged rows are in place: the loads stay
    other = str(tmp_path / "other")
    crowded(spark, other)
    with monkeypatch.context() as m:
        m.setattr(tables, "replace_partitions", crash)
        with pytest.raises(OSError):
            tables.compact_in_place(spark, other, staging)
    assert ids(spark.read.parquet(other)) == list(range(80))
    tables.append_events(data.where("CAST(id AS INT) % 8 = 2"), other, load_id=2)
    tables.compact_in_place(spark, other, staging)
    assert ids(spark.read.parquet(other)) == list(range(80))


def test_only_crowded_months_are_compacted(spark, tmp_path):
    path, staging = str(tmp_path / "events"), str(tmp_path / "staging")
    crowded(spark, path)
    later = events(spark, 100, datetime(2024, 2, 1)).where("CAST(id AS INT) >= 80")
    tables.append_events(later, path, load_id=20)
    before = glob.glob(f"{path}/event_month=2024*/**/*.parquet", recursive=True)
    assert tables.compact_in_place(spark, path, staging) == [202312]
    assert glob.glob(f"{path}/event_month=2024*/**/*.parquet", recursive=True) == before


@pytest.mark.parametrize("by_load", [True, False])
def test_delete_by_key_in_place(spark, tmp_path, by_load):
    path = str(tmp_path / "events")
    if by_load:
        loaded(spark, path)
    else:
        tables.append_events(events(spark, 60), path)
    for _ in range(2):
        tables.delete_in_place(spark, path, F.col("repo_name") == "o/r1")
    assert ids(spark.read.parquet(path)) == [i for i in range(60) if i % 3 != 1]
    tables.delete_in_place(spark, path, F.lit(None).cast("boolean"))
    assert len(ids(spark.read.parquet(path))) == 40


def test_retention_with_rows_without_a_time(spark, tmp_path):
    path = str(tmp_path / "events")
    data = events(spark)
    nameless = data.limit(2).withColumn("created_at", F.lit(None).cast("timestamp"))
    tables.append_events(data.unionByName(nameless), path)
    tables.apply_retention(spark, path, AS_OF)
    stored = spark.read.parquet(path)
    assert stored.where("created_at IS NULL").count() == 2
    assert ids(stored.where("created_at IS NOT NULL")) == ids(tables.retention_keep(data, AS_OF))


def issues(spark, rows):
    return spark.createDataFrame(
        [(i, i, f"t{i}", "", ["bug"], state, datetime(2024, 1, 1), None, "ann", "o/r") for i, state in rows],
        "id long, number long, title string, body string, labels array<string>, state string, "
        "created_at timestamp, closed_at timestamp, user_login string, repo_name string",
    )


def test_fetched_issues_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "issues")
    first = issues(spark, [(i, "open") for i in range(20)])
    second = issues(spark, [(i, "closed") for i in range(5, 25)] + [(7, "closed")])
    for fetch_id, rows in ((0, first), (1, second), (1, second), (0, first)):
        tables.store_issues(rows, path, fetch_id, buckets=4)
    stored = {r["id"]: r["state"] for r in spark.read.parquet(path).collect()}
    assert stored == {i: "open" if i < 5 else "closed" for i in range(25)}
    assert spark.read.parquet(path).count() == 25


def test_sql_sees_what_the_writers_wrote(spark, tmp_path):
    from repolume.operators import forecast
    from repolume.streaming import rollup

    folder = str(tmp_path / "db")
    schema.create_tables(spark, "written_test", folder)
    data = events(spark, 60)
    loaded(spark, f"{folder}/events")
    rollup.append_delta(rollup.rollup_delta(data), f"{folder}/daily_summary", load_id=0)
    tables.append_forecasts(forecast.forecast_repos(data, AS_OF), f"{folder}/forecasts")
    tables.store_issues(issues(spark, [(1, "open")]), f"{folder}/issues", 0)
    schema.refresh_tables(spark, "written_test")
    counts = {
        name: spark.sql(f"SELECT * FROM written_test.{name}").count()
        for name in ("events", "daily_summary", "forecasts", "issues", "releases")
    }
    assert counts["events"] == 60 and counts["issues"] == 1 and counts["releases"] == 0
    assert counts["daily_summary"] > 0 and counts["forecasts"] == 90
    total = "SELECT sum(event_count) AS n FROM written_test.daily_summary"
    assert spark.sql(total).first()["n"] == 60
    assert spark.sql("SELECT count(created_at) AS n FROM written_test.forecasts").first()["n"] == 90
    # columns are those that the writers write
    for name in ("events", "daily_summary", "forecasts", "issues"):
        written = set(spark.read.parquet(f"{folder}/{name}").columns)
        assert written == set(spark.table(f"written_test.{name}").columns)
    for name in schema.TABLES:
        spark.sql(f"DROP TABLE written_test.{name}")
    spark.sql("DROP DATABASE written_test")
