"""Continuous integration: workflow success, flaky tests, release frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, day, last_days
from repolume.workers import ship

# The failure rates, runs looked at and streak that mark a flaky test.
FLAKY_RATE = (0.10, 0.50)
RECENT_RUNS = 10
STREAK = 3

TEST = ["test_name", "repo_name"]
STATE = (
    "test_name string, repo_name string, runs long, failures long, last_failed long, "
    "critical boolean, newest array<struct<at:long,number:long,run_id:string,failed:boolean>>"
)
STATE_NAMES = ["test_name", "repo_name", "runs", "failures", "last_failed", "critical", "newest"]
FOLD_ROWS = 200_000  # runs that a task folds at once
STATE_ROWS = 1_000_000  # rows of states that a task holds


def workflow_success_rate(
    runs: DataFrame,
    as_of: AsOf,
    days: int = 7,
    column: str = "conclusion",
    success: str = "success",
) -> DataFrame:
    """Share of successful runs by workflow, lowest first; ``column`` is the one
    that holds the outcome."""
    recent = last_days(runs, as_of, days, strict=True)
    rate = F.count_if(F.col(column) == success) / F.count("*")
    return (
        recent.groupBy("workflow_name")
        .agg(rate.alias("success_rate"))
        .orderBy("success_rate", "workflow_name")
    )


def _seen(results: DataFrame, critical_workflows: list[str]) -> DataFrame:
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    return results.select(
        *TEST,
        at.alias("at"),
        F.col("run_id").cast("string").alias("run_id"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce(F.col("workflow_name").isin(critical_workflows), F.lit(False)).alias("critical"),
    )


def _folded(rows: pd.DataFrame, newest: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Totals and newest runs of each test, from rows that are single runs or totals."""
    by_test = rows.groupby(TEST, sort=False, dropna=False)
    totals = by_test.agg(
        runs=("runs", "sum"),
        failures=("failures", "sum"),
        last_failed=("last_failed", "max"),
        critical=("critical", "max"),
    )
    single = rows[rows["single"]]
    order = single.sort_values(["at", "number", "run_id"], ascending=False)
    return totals.reset_index(), order.groupby(TEST, sort=False, dropna=False).head(newest)


def test_states(
    results: DataFrame, critical_workflows: list[str], newest: int = RECENT_RUNS
) -> DataFrame:
    """test_name, repo_name, runs, failures, last_failed (microseconds), critical and newest (an
    array of at, number, run_id, failed): partial states of the tests, to be merged.

    A task folds the runs it reads to one state for each test, so a test with very many runs
    leaves a task as one row with ``newest`` runs at most.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        count = kept = 0

        def combined() -> tuple[pd.DataFrame, pd.DataFrame]:
            return _folded(pd.concat(held, ignore_index=True), newest)

        def batch_of(totals: pd.DataFrame, runs: pd.DataFrame) -> pa.RecordBatch:
            # a test's runs stand together, in the order of the totals
            place = pd.MultiIndex.from_frame(totals[TEST])
            at = place.get_indexer(pd.MultiIndex.from_frame(runs[TEST]))
            runs = runs.iloc[np.argsort(at, kind="stable")]
            ends = np.cumsum(np.bincount(at, minlength=len(totals)))
            items = pa.StructArray.from_arrays(
                [
                    pa.array(runs["at"], pa.int64(), from_pandas=True),
                    pa.array(runs["number"], pa.int64(), from_pandas=True),
                    pa.array(runs["run_id"], pa.string(), from_pandas=True),
                    pa.array(runs["failed"], pa.bool_()),
                ],
                names=["at", "number", "run_id", "failed"],
            )
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), items)
            columns = [pa.array(totals[c], pa.string(), from_pandas=True) for c in TEST]
            columns += [pa.array(totals[c], pa.int64()) for c in ("runs", "failures")]
            columns.append(pa.array(totals["last_failed"], pa.int64(), from_pandas=True))
            columns += [pa.array(totals["critical"], pa.bool_()), lists]
            return pa.RecordBatch.from_arrays(columns, names=STATE_NAMES)

        for batch in batches:
            rows = batch.to_pandas(integer_object_nulls=False)
            rows["at"] = rows["at"].astype("Int64")
            rows["number"] = pd.to_numeric(rows["run_id"], errors="coerce").astype("Int64")
            rows["runs"], rows["single"] = 1, True
            rows["failures"] = rows["failed"].astype("int64")
            rows["last_failed"] = rows["at"].where(rows["failed"])
            held.append(rows)
            count += len(rows)
            if count >= FOLD_ROWS + kept:
                totals, runs = combined()
                # the totals go on as rows that are no run
                rest = runs.assign(runs=0, failures=0, last_failed=pd.NA, critical=False)
                held = [totals.assign(single=False), rest]
                count = kept = len(totals) + len(runs)
                if kept >= STATE_ROWS:
                    yield batch_of(totals, runs)
                    held, count, kept = [], 0, 0
        if held:
            yield batch_of(*combined())

    ship(results.sparkSession)
    return _seen(results, critical_workflows).mapInArrow(fold, STATE)


def merged_states(states: DataFrame, newest: int = RECENT_RUNS) -> DataFrame:
    """One state per test from several, of tasks or of loads."""
    runs = F.sort_array(F.flatten(F.collect_list("newest")), asc=False)
    return states.groupBy(*TEST).agg(
        F.sum("runs").alias("runs"),
        F.sum("failures").alias("failures"),
        F.max("last_failed").alias("last_failed"),
        F.max("critical").alias("critical"),
        F.slice(runs, 1, newest).alias("newest"),
    )


def flaky_from_states(states: DataFrame, time_type: str = "timestamp") -> DataFrame:
    """``flaky_tests`` from merged states; ``time_type`` is that of the runs' times."""
    marks = F.array_join(
        F.transform("newest", lambda x: F.when(x["failed"], "F").otherwise(".")), ""
    )
    streaks = F.transform(F.split(marks, r"\."), lambda run: F.length(run))
    rated = states.withColumns({
        "failure_rate": F.col("failures") / F.col("runs"),
        "longest_streak": F.array_max(streaks),
        "recent_failures": F.size(F.filter("newest", lambda x: x["failed"])).cast("bigint"),
    })
    return rated.where(F.col("failure_rate").between(*FLAKY_RATE)).select(
        *TEST,
        "failure_rate",
        "recent_failures",
        F.col("runs").alias("total_runs"),
        F.timestamp_micros("last_failed").cast(time_type).alias("last_detected"),
        F.when(F.col("critical"), "high").otherwise("normal").alias("severity"),
        "longest_streak",
        (F.col("longest_streak") >= STREAK).alias("has_trend"),
    )


def flaky_tests(results: DataFrame, critical_workflows: list[str]) -> DataFrame:
    """Tests that fail in 10 to 50 % of their runs.

    ``has_trend`` reports three or more failures in a row within the last ten runs, ``severity``
    is high if the test ran in a critical workflow. Totals and last runs come from one pass
    and one shuffle, in which a test has one row of each task. Runs of one time are in the
    order of their numbers.
    """
    states = merged_states(test_states(results, critical_workflows))
    return flaky_from_states(states, results.schema["created_at"].dataType.simpleString())


def flaky_tests_recent(flaky: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Flaky tests seen in the look-back, highest failure rate first."""
    recent = last_days(flaky, as_of, days, "last_detected", strict=True)
    return recent.select("test_name", "repo_name", "failure_rate", "severity").orderBy(
        F.desc("failure_rate"), "test_name", "repo_name"
    )


def release_frequency(releases: DataFrame, as_of: AsOf, days: int = 90) -> DataFrame:
    """Releases per day, newest first."""
    recent = last_days(releases, as_of, days, strict=True)
    return (
        recent.groupBy(day(F.col("created_at")).alias("date"))
        .agg(F.count("*").alias("deployments"))
        .orderBy(F.desc("date"))
    )
