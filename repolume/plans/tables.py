"""The driver's tables seen as repository-activity tables.

Each function is a lazy mapping, so a query reads only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference times of the registered queries, just after each table's last row.
AS_OF = "2024-01-31 00:00:00"
AS_OF_TODAY = "2024-01-30 23:59:59"
AS_OF_CI = "2001-08-02 00:00:00"
# Just after the first days, in which the issues (the first rows of the table) lie.
AS_OF_ISSUES = "2024-01-04 00:00:00"
AS_OF_ISSUES_TODAY = "2024-01-02 23:59:59"

# The tables' times have microseconds; the feed text keeps them.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).try_cast("int"))


def _repo(k: str) -> str:
    return f"concat('org', {k} % 4, '/repo', {k} % 20)"


def as_activity(events: DataFrame) -> DataFrame:
    """The activity-event table from a table shaped like ``events``."""
    return _with_k(events).selectExpr(
        "CAST(event_id AS STRING) AS id",
        """CASE WHEN event_type = 'click' THEN 'PushEvent'
                WHEN event_type = 'purchase' THEN 'PullRequestEvent'
                WHEN event_type = 'error' THEN 'IssuesEvent'
                WHEN event_type = 'view' THEN 'WatchEvent'
                WHEN k < 60 THEN 'ForkEvent'
                WHEN k < 90 THEN 'CreateEvent' ELSE 'ReleaseEvent' END AS type""",
        "concat('dev', user_id) AS actor_login",
        f"{_repo('k')} AS repo_name",
        "ts AS created_at",
        """CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN
                  concat('{"action":"closed","merged":true,"number":', k,
                         ',"pull_request":{"merged_at":"',
                         replace(CAST(CAST(date_trunc('second', ts + INTERVAL '1' HOUR * k)
                                           AS TIMESTAMP_NTZ) AS STRING), ' ', 'T'), 'Z"}}')
                WHEN event_type = 'purchase' THEN
                  concat('{"action":"opened","number":', k, '}')
                WHEN event_type = 'error' AND k % 5 = 0 THEN
                  '{"action":"opened","labels":["bug"]}'
                WHEN event_type = 'click' THEN concat('{"size":', k % 10 + 1, '}')
                ELSE '{"action":"created"}' END AS payload""",
        "CASE WHEN k % 3 = 0 THEN concat('org', k % 4) END AS org_login",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_activity(read(spark, sf_dir, "events"))


def issues(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    """The issue table; queries that use no labels say so, and the table of labels is not
    read."""
    documents = read(spark, sf_dir, "documents")
    events = read(spark, sf_dir, "events").withColumnRenamed("event_id", "doc_id")
    # the number in the properties is taken from the joined rows only
    joined = _with_k(documents.join(events, "doc_id"))
    if with_labels:
        labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(
            F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
        )
        joined = joined.join(labels, "doc_id", "left")
    else:
        none = F.lit(None).cast("int")
        joined = joined.withColumns({"quality": none, "toxic": none})
    return (
        joined.selectExpr(
            "doc_id AS id",
            "doc_id % 500 + 1 AS number",
            "substr(text, 1, 60) AS title",
            "text AS body",
            """array_compact(array(CASE WHEN k % 4 <> 0 THEN lang END,
                                   CASE WHEN quality = 0 THEN 'low-quality' END,
                                   CASE WHEN toxic = 1 THEN 'toxic' END)) AS labels""",
            "CASE WHEN k % 2 = 0 THEN 'closed' ELSE 'open' END AS state",
            "ts AS created_at",
            """CASE WHEN k % 2 = 0 AND k % 10 <> 0
                    THEN ts + INTERVAL '1' HOUR * CAST(floor(value) AS INT) END AS closed_at""",
            "concat('dev', user_id) AS user_login",
            f"{_repo('k')} AS repo_name",
        )
    )


def ci_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id",
        "concat('workflow ', o_orderpriority) AS workflow_name",
        "CASE o_orderstatus WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' END AS conclusion",
        "o_orderkey AS run_number",
        "o_orderdate AS created_at",
        "o_orderdate + INTERVAL '1' HOUR AS updated_at",
        "3600L AS duration_seconds",
        f"{_repo('o_custkey')} AS repo_name",
    )


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per test and run; the lines of a run are folded before the join,
    so a run with very many lines sends at most one row per test."""
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 50).alias("test"))
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("failed"))
    )
    runs = ci_runs(spark, sf_dir).select("run_id", "repo_name", "workflow_name", "created_at")
    return lines.join(runs, "run_id").select(
        F.concat(F.lit("test_"), F.col("test").cast("string")).alias("test_name"),
        "repo_name",
        "run_id",
        "workflow_name",
        "created_at",
        (F.col("failed") == 1).alias("failed"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).where("type = 'ReleaseEvent'")


def forecast_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows for the queries that only look forecasts up: each day's own
    count for the third day after it, 5 either way."""
    daily = (
        activity(spark, sf_dir)
        .groupBy(
            F.col("repo_name").alias("repository"),
            F.date_add(F.to_date("created_at"), 3).alias("forecast_date"),
        )
        .agg(F.count("*").cast("double").alias("predicted_events"))
    )
    return daily.withColumns({
        "lower_bound": F.col("predicted_events") - 5,
        "upper_bound": F.col("predicted_events") + 5,
    })


def issue_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").selectExpr(
        "doc_id AS issue_id",
        "CASE quality WHEN 1 THEN 'keep' ELSE 'drop' END AS predicted_label",
        "1.0D AS confidence",
        "DATE '2024-01-31' AS prediction_date",
    )


def raw_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity table as the nested feed it would have come from, one JSON
    text per row. Fork events give actor, repository and organisation as plain
    strings, the others as objects; the feed allows both."""
    e = activity(spark, sf_dir).withColumn(
        "iso", F.date_format(F.col("created_at").cast("timestamp"), ISO_FORMAT)
    )
    plain = """to_json(struct(id, type, actor_login AS actor, repo_name AS repo,
        iso AS created_at, parse_json(payload) AS payload, org_login AS org))"""
    nested = """to_json(struct(id, type, named_struct('login', actor_login) AS actor,
        named_struct('name', repo_name) AS repo, iso AS created_at,
        parse_json(payload) AS payload,
        CASE WHEN org_login IS NOT NULL THEN named_struct('login', org_login) END AS org))"""
    return e.selectExpr(f"CASE WHEN type = 'ForkEvent' THEN {plain} ELSE {nested} END AS value")


def broken_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed with planted faults, by the event's number modulo 50: 0 a page cut off,
    1 a line cut off, 2 no actor, 3 a time that is none; the others as pages of one event."""
    feed = raw_event_feed(spark, sf_dir)
    n = F.get_json_object("value", "$.id").cast("long") % 50
    cut = F.expr("substr(value, 1, length(value) - 20)")
    value = (
        F.when(n == 0, F.concat(F.lit("["), "value", F.lit(","), cut))
        .when(n == 1, cut)
        .when(n == 2, F.regexp_replace("value", '"actor":', '"nobody":'))
        .when(n == 3, F.regexp_replace("value", '"created_at":"2024', '"created_at":"x2024'))
        .otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    )
    return feed.select(value.alias("value"))


def broken_issue_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue feed with planted faults, by the number modulo 10: 1 a line cut off, 2 an id
    that is no number, 3 a time that is none."""
    feed = raw_issue_feed(spark, sf_dir)
    n = F.get_json_object("value", "$.number").cast("long") % 10
    value = (
        F.when(n == 1, F.expr("substr(value, 1, length(value) - 20)"))
        .when(n == 2, F.regexp_replace("value", '^\\{"id":', '{"id":"x","other":'))
        .when(n == 3, F.regexp_replace("value", '"created_at":"2024', '"created_at":"x2024'))
        .otherwise(F.col("value"))
    )
    return feed.select("repo_name", value.alias("value"))


def raw_issue_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as their feed, one JSON text per row; numbers divisible by 7 carry
    the marker of a pull request, which the loader leaves out."""
    iso = [
        F.date_format(F.col(c).cast("timestamp"), ISO_FORMAT).alias(f"iso_{c}")
        for c in ("created_at", "closed_at")
    ]
    base = """id, number, title, body,
        transform(labels, x -> named_struct('name', x)) AS labels, state,
        iso_created_at AS created_at, iso_closed_at AS closed_at,
        named_struct('login', user_login) AS user"""
    return issues(spark, sf_dir).select("*", *iso).select(
        "repo_name",
        F.expr(
            f"""CASE WHEN number % 7 = 0
                THEN to_json(struct({base}, named_struct('url', '') AS pull_request))
                ELSE to_json(struct({base})) END"""
        ).alias("value"),
    )
