import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolume.operators import ci

CRITICAL = ["release"]


def results(spark, seed, count):
    rng = random.Random(seed)
    rows = [
        (
            f"t{rng.randrange(6)}",
            rng.choice(["o/a", "o/b"]),
            i,
            rng.choice(["ci", "release"]) if i % 9 == 0 else "ci",
            datetime(2024, 1, 1) + timedelta(hours=rng.randrange(60)),
            rng.random() < 0.3,
        )
        for i in range(count)
    ]
    return spark.createDataFrame(
        rows,
        "test_name string, repo_name string, run_id long, workflow_name string, "
        "created_at timestamp, failed boolean",
    )


def by_hand(rows):
    out = {}
    for r in rows:
        out.setdefault((r.test_name, r.repo_name), []).append(r)
    for key, runs in out.items():
        runs.sort(key=lambda r: (r.created_at, r.run_id), reverse=True)
        marks = "".join("F" if r.failed else "." for r in runs[:10])
        failed = [r.created_at for r in runs if r.failed]
        streak = max(map(len, marks.split(".")))
        out[key] = (
            len(runs), len(failed), max(failed, default=None), marks.count("F"), streak,
            any(r.workflow_name == "release" for r in runs),
        )
    return out


def found(states):
    rows = ci.merged_states(states).collect()
    out = {}
    for r in rows:
        marks = "".join("F" if x.failed else "." for x in r.newest)
        last = None if r.last_failed is None else datetime(1970, 1, 1) + timedelta(microseconds=r.last_failed)
        out[r.test_name, r.repo_name] = (
            r.runs, r.failures, last, marks.count("F"), max(map(len, marks.split("."))), r.critical
        )
    return out


@pytest.mark.parametrize("fold, state", [(200_000, 1_000_000), (40, 1_000_000), (40, 30)])
def test_states_fold_and_merge(spark, monkeypatch, fold, state):
    monkeypatch.setattr(ci, "FOLD_ROWS", fold)
    monkeypatch.setattr(ci, "STATE_ROWS", state)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        data = results(spark, 1, 700)
        want = by_hand(data.collect())
        for partitions in (1, 5):
            assert found(ci.test_states(data.repartition(partitions), CRITICAL)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_states_of_loads_are_merged(spark):
    data = results(spark, 2, 300)
    loads = [ci.test_states(data.where(F.col("run_id") % 3 == k), CRITICAL) for k in range(3)]
    merged = ci.merged_states(loads[0].unionByName(loads[1]))
    assert found(merged.unionByName(loads[2])) == by_hand(data.collect())


def test_one_scan_and_no_failures(spark, tmp_path):
    path = str(tmp_path / "results")
    results(spark, 3, 50).withColumn("failed", F.lit(None).cast("boolean")).write.parquet(path)
    table = spark.read.parquet(path)
    assert ci.flaky_tests(table, CRITICAL).collect() == []
    plan = ci.flaky_tests(table, CRITICAL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert ci.flaky_tests(table.where("run_id < 0"), CRITICAL).collect() == []
