import glob

import pytest
from pyspark.sql import functions as F

from repolume.sources import issues as store
from repolume.sources import tables
from tests.test_tables import issues


def state(spark, path):
    rows = store.read_issues(spark, path).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["state"] for r in rows}


def written(spark, path):
    return sum(spark.read.parquet(f).count() for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_a_fetch_writes_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "issues")
    store.append_fetch(issues(spark, [(i, "open") for i in range(500)]), path, 0)
    assert store.fold_fetches(spark, path, buckets=4)
    before = written(spark, path)
    store.append_fetch(issues(spark, [(i, "closed") for i in range(490, 510)]), path, 1)
    assert written(spark, path) == before + 20
    assert not store.fold_fetches(spark, path)  # few beside the base
    assert state(spark, path) == {i: "closed" if i >= 490 else "open" for i in range(510)}


@pytest.mark.parametrize("folds", [(), (0,), (1, 3), (0, 1, 2, 3)])
def test_reads_equal_the_table_of_single_rows(spark, tmp_path, folds):
    first = issues(spark, [(i, "open") for i in range(20)])
    second = issues(spark, [(i, "closed") for i in range(5, 25)] + [(7, "closed")])
    third = issues(spark, [(i, "reopened") for i in range(0, 30, 3)])
    path, other = str(tmp_path / "issues"), str(tmp_path / "other")
    for k, (fetch_id, rows) in enumerate(((0, first), (1, second), (2, third), (1, second), (0, first))):
        store.append_fetch(rows, path, fetch_id)
        tables.store_issues(rows, other, fetch_id, buckets=4)
        if k in folds:
            store.fold_fetches(spark, path, share=0.0, buckets=4 + k)
        want = {r["id"]: r["state"] for r in spark.read.parquet(other).collect()}
        assert state(spark, path) == want


def test_a_folding_that_was_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "issues")
    store.append_fetch(issues(spark, [(1, "open"), (2, "open")]), path, 0)
    store.fold_fetches(spark, path)
    store.append_fetch(issues(spark, [(2, "closed"), (3, "open")]), path, 1)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "delete_folder", crash)
        with pytest.raises(OSError):
            store.fold_fetches(spark, path)
    want = {1: "open", 2: "closed", 3: "open"}
    assert state(spark, path) == want
    store.fold_fetches(spark, path, share=0.0)
    assert state(spark, path) == want
    assert len(glob.glob(f"{path}/base/generation=*")) == 1


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    path = str(tmp_path / "issues")
    rows = issues(spark, [(i, "open") for i in range(20)])
    tables.store_issues(rows, path, 0, buckets=8)
    with pytest.raises(ValueError, match="8 buckets"):
        tables.store_issues(rows, path, 1)
    tables.store_issues(rows, path, 1, buckets=8)
    assert spark.read.parquet(path).count() == 20


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(ValueError):
        store.read_issues(spark, str(tmp_path / "none"))
    assert not store.fold_fetches(spark, str(tmp_path / "none"))


def test_rows_are_shuffled_without_their_json(spark):
    rows = issues(spark, [(1, "open")]).withColumn("fetch_id", F.lit(0).cast("bigint"))
    found = store._newest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "to_json" in found or "structstojson" in found.lower()
    below = found[found.rindex("Exchange") :].lower()
    assert "to_json" not in below and "structstojson" not in below
    assert found.count("Exchange") == 1


def test_rows_of_one_fetch_are_told_apart_by_their_json(spark, tmp_path):
    rows = issues(spark, [(1, "open"), (1, "closed"), (2, "open"), (2, "open"), (3, "closed")])
    want = {1: "closed", 2: "open", 3: "closed"}
    path, other = str(tmp_path / "issues"), str(tmp_path / "other")
    store.append_fetch(rows, path, 0)
    assert state(spark, path) == want
    assert store.fold_fetches(spark, path, buckets=4)
    assert state(spark, path) == want
    tables.store_issues(rows, other, 0, buckets=4)
    assert sorted((r["id"], r["state"]) for r in spark.read.parquet(other).collect()) == [*want.items()]
