import glob
import os

import pytest
from pyspark.sql import functions as F

from repolume.sources import keyindex, tables
from tests.test_tables import events, ids


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def keyed(spark, path, index, loads=4, n=400):
    """Each load has a repository of its own beside those of all."""
    data = events(spark, n).withColumn(
        "repo_name",
        F.when(F.col("id").cast("int") % 50 < loads, F.concat(F.lit("own/r"), F.col("id").cast("int") % 50))
        .otherwise(F.col("repo_name")),
    )
    for load in range(loads):
        rows = data.where(F.col("id").cast("int") % 50 % loads == load)
        tables.append_events(rows, path, load_id=load)
    keyindex.index_table(spark, path, index)
    return data


def test_a_rare_key_is_deleted_from_its_partitions_alone(spark, tmp_path):
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    data = keyed(spark, path, index)
    held = {
        (r["event_month"], r["load_id"])
        for r in spark.read.parquet(path).where("repo_name = 'own/r2'").select("event_month", "load_id").collect()
    }
    before = files(path)
    looked_at = keyindex.delete_keys(spark, path, index, "repo_name", ["own/r2"])
    assert held <= set(looked_at)
    partitions = spark.read.parquet(path).select("event_month", "load_id").distinct().count()
    assert len(looked_at) < partitions / 2
    assert ids(spark.read.parquet(path)) == ids(data.where("repo_name <> 'own/r2'"))
    for file, written in before.items():
        if not any(f"event_month={m}/load_id={n}/" in file for m, n in looked_at):
            assert os.path.getmtime(file) == written
    assert keyindex.delete_keys(spark, path, index, "repo_name", []) == []


def test_the_pieces_of_the_filters_are_dealt_out_before_they_are_sorted(spark):
    """The bitmap aggregate sorts: no task sorts the positions of its whole input."""
    table = events(spark, 100).selectExpr("*", "202401 AS event_month", "0L AS load_id")
    plan = keyindex.index_rows(table)._jdf.queryExecution().executedPlan().toString()
    partial = plan.split("partial_bitmap_construct_agg")[1]
    sort, exchange = partial.index("Sort ["), partial.index("Exchange hashpartitioning")
    assert sort < exchange and "piece" in partial[exchange:].split("\n")[0]


def test_look_ups_find_every_key(spark, tmp_path):
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    data = keyed(spark, path, index)
    for name in ("o/r1", "own/r0", "own/r3"):
        found = keyindex.rows_of_keys(spark, path, index, "repo_name", [name, "x"])
        assert ids(found) == ids(data.where(F.col("repo_name") == name))
    for i in range(0, 400, 37):
        assert ids(keyindex.rows_of_keys(spark, path, index, "id", [i])) == [i]
    assert keyindex.may_hold(spark, path, index, "id", ["zzz"]).collect() == []
    # an index of many keys answers falsely for few others
    asked = [str(i) for i in range(10_000, 10_300)]
    wrong = [v for v in asked[:30] if keyindex.may_hold(spark, path, index, "id", [v]).count() > 2]
    assert len(wrong) <= 3


def test_partitions_written_after_the_index_are_looked_at(spark, tmp_path):
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    keyed(spark, path, index)
    late = events(spark, 30).withColumns(
        {"id": (F.col("id").cast("int") + 1000).cast("string"), "repo_name": F.lit("late/r")}
    )
    tables.append_events(late, path, load_id=9)
    # a load that comes again with other rows
    changed = events(spark, 3).withColumn("repo_name", F.lit("changed/r"))
    tables.append_events(changed, path, load_id=0)
    assert ids(keyindex.rows_of_keys(spark, path, index, "repo_name", ["late/r"])) == list(range(1000, 1030))
    assert keyindex.rows_of_keys(spark, path, index, "repo_name", ["changed/r"]).count() == 3
    count = keyindex.index_table(spark, path, index)
    assert count > 0 and keyindex.index_table(spark, path, index) == 0
    assert ids(keyindex.rows_of_keys(spark, path, index, "repo_name", ["late/r"])) == list(range(1000, 1030))
    assert len(keyindex.may_hold(spark, path, index, "repo_name", ["late/r"]).collect()) <= 3


@pytest.mark.parametrize("indexed", [True, False])
def test_tables_without_loads(spark, tmp_path, indexed):
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    data = events(spark, 90)
    nameless = data.limit(1).withColumns({"created_at": F.lit(None).cast("timestamp"), "id": F.lit("500")})
    tables.append_events(data.unionByName(nameless), path)
    if indexed:
        keyindex.index_table(spark, path, index)
    assert ids(keyindex.rows_of_keys(spark, path, index, "id", ["500", "4"])) == [4, 500]
    keyindex.delete_keys(spark, path, index, "id", ["500", "4"])
    assert ids(spark.read.parquet(path)) == [i for i in range(90) if i != 4]
