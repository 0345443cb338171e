"""Table schemas, and the statements that create them in a catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("actor_login", T.StringType(), False),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("org_login", T.StringType(), True),
    T.StructField("_inserted_at", T.TimestampType(), True),
])

DAILY_SUMMARY = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("event_count", T.LongType(), False),
    T.StructField("unique_users", T.LongType(), False),
    T.StructField("users_sketch", T.BinaryType(), True),
])

FORECASTS = T.StructType([
    T.StructField("repository", T.StringType(), False),
    T.StructField("forecast_date", T.DateType(), False),
    T.StructField("predicted_events", T.DoubleType(), False),
    T.StructField("lower_bound", T.DoubleType(), False),
    T.StructField("upper_bound", T.DoubleType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("training_date", T.DateType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

ISSUES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("number", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("labels", T.ArrayType(T.StringType()), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("closed_at", T.TimestampType(), True),
    T.StructField("user_login", T.StringType(), True),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("fetch_id", T.LongType(), True),
])

ISSUE_PREDICTIONS = T.StructType([
    T.StructField("issue_id", T.LongType(), False),
    T.StructField("predicted_label", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("prediction_date", T.DateType(), False),
])

REPO_ACTIVITY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("repository", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("user_login", T.StringType(), False),
    ]
    + [
        T.StructField(counter, T.LongType(), False)
        for counter in (
            "commits", "additions", "deletions", "issues_opened", "issues_closed",
            "pull_requests_opened", "pull_requests_merged",
        )
    ]
)

CI_WORKFLOW_RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("workflow_name", T.StringType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("conclusion", T.StringType(), True),
    T.StructField("run_number", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("duration_seconds", T.LongType(), True),
    T.StructField("repo_name", T.StringType(), False),
])

FLAKY_TESTS = T.StructType([
    T.StructField("test_name", T.StringType(), False),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("failure_rate", T.DoubleType(), False),
    T.StructField("recent_failures", T.LongType(), False),
    T.StructField("total_runs", T.LongType(), False),
    T.StructField("last_detected", T.TimestampType(), True),
    T.StructField("severity", T.StringType(), False),
])

# One element of the issue feed, as far as it is read.
ISSUE_FEED = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("state", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("closed_at", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
])

RELEASES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("payload", T.StringType(), True),
])

TABLES = {
    "events": EVENTS,
    "daily_summary": DAILY_SUMMARY,
    "forecasts": FORECASTS,
    "issues": ISSUES,
    "issue_predictions": ISSUE_PREDICTIONS,
    "repo_activity": REPO_ACTIVITY,
    "ci_workflow_runs": CI_WORKFLOW_RUNS,
    "flaky_tests": FLAKY_TESTS,
    "releases": RELEASES,
}

# Partitions, filled on write by the functions that load these tables.
PARTITIONS = {
    "events": "event_month INT, load_id BIGINT",
    "daily_summary": "event_month INT, load_id BIGINT",
    "issues": "bucket INT",
}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in schema.fields
    )


def create_tables(spark: SparkSession, database: str, folder: str | None = None) -> list[str]:
    """Create the database and its parquet tables if absent; return the names.

    With ``folder`` each table lies in the subfolder of its name, which is the path to give to
    the functions that load it: what they write is what SQL on the table sees, after
    ``refresh_tables``.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for table, schema in TABLES.items():
        columns = _ddl(schema)
        partition = place = ""
        if table in PARTITIONS:
            columns += f", {PARTITIONS[table]}"
            keys = ", ".join(part.split()[0] for part in PARTITIONS[table].split(", "))
            partition = f"PARTITIONED BY ({keys})"
        if folder is not None:
            place = f"LOCATION '{folder.rstrip('/')}/{table}'"
        name = f"`{database}`.`{table}`"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {partition} {place}"
        )
        names.append(f"{database}.{table}")
    return names


def refresh_tables(spark: SparkSession, database: str) -> None:
    """Make rows visible that were written to the tables' folders."""
    for table in TABLES:
        name = f"`{database}`.`{table}`"
        spark.sql(f"REFRESH TABLE {name}")
        if table in PARTITIONS:
            spark.sql(f"MSCK REPAIR TABLE {name}")  # find the partitions that were written
