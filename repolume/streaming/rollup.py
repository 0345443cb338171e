"""The daily rollup: an append-only table of deltas, one set per load.

A delta row holds a load's events of one (day, repository, type), its distinct
users, and a sketch of them. Two reads exist: ``summed_rollup`` adds the users
of the loads, so one seen in two loads counts twice; ``merged_rollup`` unites
the sketches, so one counts once (an estimate beyond a few hundred users).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.functions.timecols import day, month_key
from repolume.sources.tables import LOAD, MONTH, merged_months, replace_partitions

KEY = ["date", "repo_name", "event_type"]
# Sketch size: 2^12 registers, about 1.6 % error.
LOG_REGISTERS = 12


def rollup_delta(events: DataFrame, *load: str) -> DataFrame:
    """The delta rows of a block of events (of each load, if ``load`` columns
    are named). Events are counted per user first, so a sketch is made once per
    key and task, not once per user."""
    key = [*load, *KEY]
    per_user = events.groupBy(
        *load,
        day(F.col("created_at")).alias("date"),
        "repo_name",
        F.col("type").alias("event_type"),
        "actor_login",
    ).agg(F.count("*").alias("n"))
    return per_user.groupBy(*key).agg(
        F.sum("n").alias("event_count"),
        F.count("actor_login").alias("unique_users"),
        F.hll_sketch_agg("actor_login", LOG_REGISTERS).alias("users_sketch"),
    )


def append_delta(delta: DataFrame, path: str, load_id: int | None = None) -> None:
    """Store a load's delta under its own partitions, so a repeated load replaces
    itself; without ``load_id`` the delta has a column of that name."""
    rows = delta.withColumn(MONTH, month_key(F.col("date")))
    if load_id is not None:
        rows = rows.withColumn(LOAD, F.lit(load_id).cast("bigint"))
        merged = merged_months(delta.sparkSession, path, load_id)
        if merged:
            rows = rows.where(~F.col(MONTH).isin(merged))
    replace_partitions(rows, path)


def summed_rollup(rollup: DataFrame) -> DataFrame:
    """Counts and users added over loads."""
    return rollup.groupBy(*KEY).agg(
        F.sum("event_count").alias("event_count"),
        F.sum("unique_users").alias("unique_users"),
    )


def merged_rollup(rollup: DataFrame) -> DataFrame:
    """Counts added, users united over loads."""
    return rollup.groupBy(*KEY).agg(
        F.sum("event_count").alias("event_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users"),
    )


def collapse_rollup(rollup: DataFrame) -> DataFrame:
    """The deltas of all loads as one delta per key, for rewriting the table;
    ``unique_users`` stays the sum over loads."""
    return rollup.groupBy(*KEY).agg(
        F.sum("event_count").alias("event_count"),
        F.sum("unique_users").alias("unique_users"),
        F.hll_union_agg("users_sketch").alias("users_sketch"),
    )
