"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.operators import (
    additive,
    anomalies,
    ci,
    classifier,
    contributors,
    delivery,
    forecast,
    issues,
    panels,
    repositories,
    traffic,
)
from repolume.plans import tables as t
from repolume.plans.tables import (
    AS_OF,
    AS_OF_CI,
    AS_OF_ISSUES,
    AS_OF_ISSUES_TODAY,
    AS_OF_TODAY,
)
from repolume import schema
from repolume.sources import feeds, keyindex, lookback, payloads, scoring, sqlentry, thresholds
from repolume.sources import issues as issue_store
from repolume.sources import tables as store
from repolume.streaming import actors, ingest, limits, rollup
from repolume.workspace import new_path

Query = Callable[[SparkSession, str], DataFrame]

RANGE_START = "2024-01-01 00:00:00"
RANGE_END = AS_OF
# A day inside the data's month, so that retention has something to delete.
RETENTION_AS_OF = "2024-04-15 12:00:00"
CRITICAL_WORKFLOWS = ["workflow 1-URGENT"]
# Fixed value: the repository of the single-repository forecast panel.
FORECAST_REPO = "org0/repo0"

QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _state_of(spark: SparkSession, d: str, *tables: str) -> tuple:
    """What some tables are just now: names, lengths and times of their files."""
    state = [spark.sparkContext.applicationId]
    for name in tables:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        files = files.load(f"{d}/{name}.parquet")
        seen = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
        state.append(files.agg(seen).first()[0])
    return tuple(state)


_WRITTEN: dict[tuple, str] = {}


def _kept(
    spark: SparkSession, d: str, name: str, build: Callable[[str], None], tables: tuple = ("events",)
) -> str:
    """The path of a table that several queries read and none changes: written once for an
    application, while the files that it is made of are the same."""
    state = (name, *_state_of(spark, d, *tables))
    if state not in _WRITTEN or not store.file_exists(spark, _WRITTEN[state]):
        path = new_path(spark, name)
        build(path)
        _WRITTEN[state] = path
    return _WRITTEN[state]


def on_events(name: str, operator, *args, **kwargs) -> None:
    """Register an operator whose only table is the activity table."""
    QUERIES[name] = lambda spark, d: operator(t.activity(spark, d), *args, **kwargs)


def on_issues(name: str, operator, *args, with_labels: bool = False, **kwargs) -> None:
    QUERIES[name] = lambda spark, d: operator(
        t.issues(spark, d, with_labels=with_labels), *args, **kwargs
    )


# --- repositories, contributors, traffic ---------------------------------------

on_events("trending_repositories", repositories.trending_repositories, AS_OF)
on_events("repository_stats", repositories.repository_stats)
on_events("detailed_analytics", repositories.detailed_analytics, AS_OF)
on_events("event_type_summary", repositories.event_type_summary, AS_OF)
on_events("developer_velocity", repositories.developer_velocity, AS_OF)
on_events("community_health", repositories.community_health, AS_OF)
on_events("list_repos", repositories.list_repos)
on_events("list_event_types", repositories.list_event_types)
on_events("repo_activity_ranking", repositories.repo_activity_ranking, AS_OF)
on_events(
    "repo_activity_ranking_range",
    repositories.repo_activity_ranking,
    start=RANGE_START,
    end=RANGE_END,
)
on_events("repo_activity_summary", repositories.repo_activity_ranking, limit=None)
on_events("top_contributors", contributors.top_contributors, AS_OF)
on_events(
    "top_contributors_range", contributors.top_contributors, start=RANGE_START, end=RANGE_END
)
on_events("top_contributors_by_repo", contributors.top_contributors_by_repo)
on_events("daily_activity", traffic.daily_activity)
on_events("event_type_counts", traffic.event_type_counts)
on_events("event_type_counts_range", traffic.event_type_counts, RANGE_START, RANGE_END)
on_events("event_types_by_repo", traffic.event_types_by_repo)
on_events("event_traffic_daily", traffic.event_traffic_daily, RANGE_START, RANGE_END)
on_events("event_traffic_epoch_ms", traffic.event_traffic_epoch_ms)
on_events("hourly_activity", traffic.hourly_activity, RANGE_START, RANGE_END)
on_events("release_annotations", traffic.release_annotations, AS_OF)


@register
def repository_stats_approx(spark: SparkSession, d: str) -> DataFrame:
    """Approximate contributors beside the exact count: within five times the stated error of
    1 % (and one contributor)."""
    events = t.activity(spark, d)
    exact = repositories.repository_stats(events).select(
        "repo_name", F.col("unique_contributors").alias("exact_contributors")
    )
    both = repositories.repository_stats(events, approx=True).join(exact, "repo_name")
    off = F.abs(F.col("unique_contributors") - F.col("exact_contributors"))
    within = off <= F.greatest(F.lit(1.0), 0.05 * F.col("exact_contributors"))
    return both.select("repo_name", "total_events", "exact_contributors", within.alias("within"))


@register
def repository_profile(spark: SparkSession, d: str) -> DataFrame:
    profile = repositories.repository_profile(t.activity(spark, d))
    return profile.select(
        "repo_name",
        "total_events",
        "unique_contributors",
        "last_activity",
        F.explode("event_types").alias("event_type", "event_count"),
    )


@register
def contributor_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = repositories.contributor_stats(t.activity(spark, d))
    return stats.select(
        "username",
        "total_contributions",
        "first_contribution",
        "last_contribution",
        F.explode("contribution_types").alias("event_type", "event_count"),
    )


@register
def detailed_analytics_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = repositories.detailed_analytics_nested(t.activity(spark, d), AS_OF)
    by_day = nested.select(
        "repo_name",
        "period_days",
        "event_type_summary",
        F.explode("daily_breakdown").alias("date", "types"),
    )
    by_type = by_day.select(
        "repo_name",
        "period_days",
        "event_type_summary",
        "date",
        F.explode("types").alias("event_type", "counts"),
    )
    return by_type.select(
        "repo_name",
        "period_days",
        "date",
        "event_type",
        F.col("counts.count").alias("event_count"),
        F.col("counts.unique_users").alias("unique_users"),
        F.col("event_type_summary")[F.col("event_type")].alias("type_total"),
    )


# --- all panels of a range at once ---------------------------------------------

on_events("event_panels", panels.event_panels, RANGE_START, RANGE_END)
on_issues("issue_panels", panels.issue_panels, RANGE_START, RANGE_END, with_labels=True)


# --- delivery ------------------------------------------------------------------

on_events("deployment_count", delivery.deployment_count, AS_OF)
on_events("deployment_count_by_repo", delivery.deployment_count, AS_OF, by_repo=True)
on_events("deployment_frequency_weekly", delivery.deployment_frequency_weekly, AS_OF)
on_events("lead_time_hours", delivery.lead_time_hours, AS_OF)
on_events("lead_time_hours_by_repo", delivery.lead_time_hours, AS_OF, by_repo=True)
on_issues("mttr_hours", delivery.mttr_hours, AS_OF)
on_issues("mttr_hours_30d", delivery.mttr_hours, AS_OF, 30, default=None)
on_issues("mttr_hours_by_repo", delivery.mttr_hours, AS_OF, by_repo=True)
on_issues("mttr_hours_exact", delivery.mttr_hours_exact)
on_events("change_failure_rate", delivery.change_failure_rate, AS_OF)
on_events("change_failure_rate_unguarded", delivery.change_failure_rate, AS_OF, guarded=False)
on_events("change_failure_rate_by_repo", delivery.change_failure_rate, AS_OF, by_repo=True)


@register
def metric_bands(spark: SparkSession, d: str) -> DataFrame:
    steps = delivery.full_steps(thresholds.DEFAULTS)
    return delivery.metric_bands(t.activity(spark, d), t.issues(spark, d), AS_OF, steps)


@register
def metric_bands_short(spark: SparkSession, d: str) -> DataFrame:
    return delivery.metric_bands(
        t.activity(spark, d), t.issues(spark, d), AS_OF, delivery.SHORT_STEPS, long_days=30
    )


def _parsed_events(spark: SparkSession, d: str) -> DataFrame:
    """The events stored with the members of their payloads."""
    path = _kept(
        spark, d, "parsed-events", lambda p: payloads.append_parsed(t.activity(spark, d), p, 0)
    )
    return spark.read.parquet(path)


@register
def lead_time_hours_parsed(spark: SparkSession, d: str) -> DataFrame:
    return delivery.lead_time_hours(_parsed_events(spark, d), AS_OF, by_repo=True)


@register
def metric_bands_parsed(spark: SparkSession, d: str) -> DataFrame:
    steps = delivery.full_steps(thresholds.DEFAULTS)
    return delivery.metric_bands(
        _parsed_events(spark, d), t.issues(spark, d, with_labels=False), AS_OF, steps
    )


@register
def payload_members(spark: SparkSession, d: str) -> DataFrame:
    """Members that no column holds, read from the variant: sizes and actions by type."""
    events = _parsed_events(spark, d)
    return events.groupBy("type", payloads.member("$.action", "string").alias("action")).agg(
        F.count("*").alias("events"),
        F.sum(payloads.member("$.size", "bigint")).alias("total_size"),
        F.count(payloads.member("$.pull_request.merged_at", "string")).alias("merge_times"),
    )


@register
def rejected_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with planted faults by the event's number modulo 50: 0 cut off, 1 a list, 2 a
    member named twice, 3 none. All rows are stored; by month and reason."""
    n = F.col("id").cast("long") % 50
    text = (
        F.when(n == 0, F.expr("substr(payload, 1, length(payload) - 1)"))
        .when(n == 1, F.concat(F.lit("["), "payload", F.lit("]")))
        .when(n == 2, F.lit('{"merged":1,"merged":2}'))
        .when(n != 3, F.col("payload"))
    )
    path = new_path(spark, "broken-payloads")
    payloads.append_parsed(t.activity(spark, d).withColumn("payload", text), path, load_id=0)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("event_month").cast("bigint").alias("event_month"),
                          F.col(payloads.ERROR).alias("error")).agg(
        F.count("*").alias("events"), F.count("payload").alias("texts")
    )


@register
def event_traffic_bands(spark: SparkSession, d: str) -> DataFrame:
    daily = traffic.event_traffic_daily(t.activity(spark, d))
    steps = delivery.traffic_steps(thresholds.DEFAULTS["events_per_day"])
    return delivery.with_band(daily, "events", steps)


# --- issues --------------------------------------------------------------------

on_issues("issues_by_state", issues.issues_by_state)
on_issues("open_issues", issues.open_issues)
on_issues("open_issues_by_repo", issues.open_issues, by_repo=True)
on_issues("top_labels", issues.top_labels, with_labels=True)
on_issues("top_labels_recent", issues.top_labels, AS_OF_ISSUES, with_labels=True)
on_issues("issues_created_daily", issues.issues_created_daily)


@register
def predicted_label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return issues.predicted_label_distribution(t.issue_predictions(spark, d))


# --- limits, health, diagnostics -----------------------------------------------


@register
def dynamic_thresholds(spark: SparkSession, d: str) -> DataFrame:
    row = anomalies.dynamic_thresholds(t.activity(spark, d), t.issues(spark, d), AS_OF)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@register
def system_health(spark: SparkSession, d: str) -> DataFrame:
    rows = anomalies.system_health(t.activity(spark, d), t.issues(spark, d), AS_OF_TODAY)
    return rows.withColumns({c: F.round(c, 6) for c in ("current", "threshold")})


@register
def system_health_busy(spark: SparkSession, d: str) -> DataFrame:
    """On a day that has issues, against the limit of the days until then."""
    rows = anomalies.system_health(t.activity(spark, d), t.issues(spark, d, False), AS_OF_ISSUES_TODAY)
    return rows.withColumns({c: F.round(c, 6) for c in ("current", "threshold")})


@register
def system_health_static_busy(spark: SparkSession, d: str) -> DataFrame:
    rows = anomalies.system_health_static(
        t.activity(spark, d), t.issues(spark, d, False), AS_OF_ISSUES_TODAY
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("current", "threshold")})


@register
def system_health_static(spark: SparkSession, d: str) -> DataFrame:
    rows = anomalies.system_health_static(t.activity(spark, d), t.issues(spark, d), AS_OF)
    return rows.withColumns({c: F.round(c, 6) for c in ("current", "threshold")})


@register
def daily_anomalies(spark: SparkSession, d: str) -> DataFrame:
    rows = anomalies.daily_anomalies(t.activity(spark, d), AS_OF)
    return rows.withColumn("threshold", F.round("threshold", 6))


@register
def daily_anomalies_flagged(spark: SparkSession, d: str) -> DataFrame:
    """All events, those of one day six times: a day that stands out."""
    events = t.activity(spark, d)
    busy = events.where(F.to_date("created_at") == F.lit("2024-01-15").cast("date"))
    copies = busy.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_copy")
    rows = anomalies.daily_anomalies(events.unionByName(copies), AS_OF)
    return rows.withColumn("threshold", F.round("threshold", 6))


@register
def daily_anomalies_of_repos(spark: SparkSession, d: str) -> DataFrame:
    """The repositories given as a table: those that had a release."""
    chosen = t.releases(spark, d).select("repo_name").where("repo_name < 'org2'").distinct()
    rows = anomalies.daily_anomalies(t.activity(spark, d), AS_OF, repos=chosen)
    return rows.withColumn("threshold", F.round("threshold", 6))


@register
def data_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.data_diagnostics(
        t.activity(spark, d), t.issues(spark, d), t.forecast_standin(spark, d), AS_OF
    )


on_events("sample_repos", anomalies.sample_repos)


# --- continuous integration ----------------------------------------------------


@register
def workflow_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return ci.workflow_success_rate(t.ci_runs(spark, d), AS_OF_CI)


@register
def workflow_success_rate_by_status(spark: SparkSession, d: str) -> DataFrame:
    return ci.workflow_success_rate(
        t.ci_runs(spark, d), AS_OF_CI, days=3000, column="status", success="completed"
    )


@register
def flaky_tests(spark: SparkSession, d: str) -> DataFrame:
    return ci.flaky_tests(t.test_results(spark, d), CRITICAL_WORKFLOWS)


@register
def flaky_tests_of_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Tests by workflow, so that some run in the critical one and others never do."""
    results = t.test_results(spark, d).withColumn(
        "test_name", F.concat_ws("@", "test_name", "workflow_name")
    )
    return ci.flaky_tests(results, CRITICAL_WORKFLOWS)


@register
def flaky_tests_recent(spark: SparkSession, d: str) -> DataFrame:
    flaky = ci.flaky_tests(t.test_results(spark, d), CRITICAL_WORKFLOWS)
    return ci.flaky_tests_recent(flaky, AS_OF_CI)


@register
def release_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ci.release_frequency(t.releases(spark, d), AS_OF)


# --- forecasts -----------------------------------------------------------------

on_events("forecast_training_series", forecast.training_series)
on_events("forecast_repos", forecast.forecast_repos, AS_OF)
on_events("forecast_backtest", forecast.backtest, AS_OF)


@register
def forecast_repos_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_repos(t.ci_runs(spark, d), AS_OF_CI)


@register
def forecast_repos_yearly(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_repos(t.activity(spark, d), AS_OF, yearly=True)


@register
def forecast_repos_plain(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_repos(t.ci_runs(spark, d), AS_OF_CI, yearly=False)


on_events("forecast_additive", additive.forecast_additive, AS_OF)
on_events("forecast_additive_backtest", additive.backtest, AS_OF)


@register
def forecast_additive_yearly(spark: SparkSession, d: str) -> DataFrame:
    """Over years of runs, with the yearly waves."""
    return additive.forecast_additive(t.ci_runs(spark, d), AS_OF_CI)


@register
def forecast_additive_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = additive.trend_changes(t.ci_runs(spark, d))
    return rows.withColumn("slope_change", F.round("slope_change", 6))


def _stored_forecasts(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "forecasts")
    store.append_forecasts(forecast.forecast_repos(t.activity(spark, d), AS_OF), path)
    return path


@register
def train_all_forecasts(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.read.parquet(_stored_forecasts(spark, d))
    return stored.where("created_at IS NOT NULL").drop("created_at")


@register
def forecast_lookup(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_lookup(t.forecast_standin(spark, d))


@register
def forecast_series(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_series(t.forecast_standin(spark, d), FORECAST_REPO)


@register
def forecast_vs_actual_long(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_vs_actual_long(
        t.activity(spark, d), t.forecast_standin(spark, d), AS_OF
    )


@register
def forecast_vs_actual_wide(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_vs_actual_wide(
        t.activity(spark, d), t.forecast_standin(spark, d), AS_OF
    )


# --- classifier ----------------------------------------------------------------

_MODELS: dict[tuple, PipelineModel] = {}
_MODEL_TABLES = ("documents", "events", "labels")


def trained_model(spark: SparkSession, d: str, fresh: bool = False) -> PipelineModel:
    """The classifier of a data set: fitted on the training part, saved and loaded. The
    queries that only apply it share it while the files of the data are the same."""
    state = _state_of(spark, d, *_MODEL_TABLES)
    if fresh or state not in _MODELS:
        rows = classifier.in_valid_classes(classifier.training_rows(t.issues(spark, d)))
        train_part = classifier.with_split(rows).where("split = 'train'")
        path = new_path(spark, "classifier")
        classifier.save_model(classifier.train(train_part), path)
        _MODELS[state] = classifier.load_model(path)
    return _MODELS[state]


def _test_report(spark: SparkSession, d: str, model: PipelineModel) -> DataFrame:
    rows = classifier.in_valid_classes(classifier.training_rows(t.issues(spark, d)))
    test_part = classifier.with_split(rows).where("split = 'test'")
    return classifier.classification_report(classifier.predict_split(test_part, model))


@register
def train_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Trains, and tells whether the model gets nine in ten of the test part right."""
    report = _test_report(spark, d, trained_model(spark, d, fresh=True))
    report = report.where("class = 'accuracy'")
    return report.select("support", (F.col("f1_score") >= 0.9).alias("good"))


@register
def score_issues_checked(spark: SparkSession, d: str) -> DataFrame:
    """The issues that got a prediction, and whether label and confidence can be ones."""
    labels = classifier.valid_classes(classifier.training_rows(t.issues(spark, d)))
    known = labels.select(F.col("label").alias("predicted_label"), F.lit(True).alias("known"))
    scored = score_issues(spark, d).join(known, "predicted_label", "left")
    return scored.select(
        "issue_id",
        F.coalesce("known", F.lit(False)).alias("valid_label"),
        ((F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("valid_confidence"),
        "prediction_date",
    )


@register
def classify_texts_checked(spark: SparkSession, d: str) -> DataFrame:
    rows = classify_texts(spark, d)
    valid = (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    return rows.select("id", (valid & F.col("predicted_label").isNotNull()).alias("valid"))


@register
def classifier_training_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = classifier.training_rows(t.issues(spark, d))
    return rows.select("id", "label", F.length("text").cast("bigint").alias("text_length"))


on_issues(
    "valid_classes",
    lambda df: classifier.valid_classes(classifier.training_rows(df)),
    with_labels=True,
)
on_issues(
    "train_test_split",
    lambda df: classifier.with_split(
        classifier.in_valid_classes(classifier.training_rows(df))
    ).select("id", "label", "split"),
    with_labels=True,
)


@register
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    rated = t.read(spark, d, "labels").selectExpr(
        "CASE quality WHEN 1 THEN 'keep' ELSE 'drop' END AS label",
        "CASE toxic WHEN 0 THEN 'keep' ELSE 'drop' END AS prediction",
    )
    report = classifier.classification_report(rated)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@register
def classifier_test_report(spark: SparkSession, d: str) -> DataFrame:
    return _test_report(spark, d, trained_model(spark, d))


@register
def unscored_issues(spark: SparkSession, d: str) -> DataFrame:
    left = classifier.unscored_issues(t.issues(spark, d), t.issue_predictions(spark, d))
    return left.select("id", "title")


@register
def unscored_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The issues without a prediction, both tables stored by buckets; the predictions are
    loaded twice."""
    database = f"scored_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    names = [f"{database}.{name}" for name in ("issues", "predictions")]
    paths = [new_path(spark, f"bucketed-{name}") for name in ("issues", "predictions")]
    try:
        scoring.store_scorable(t.issues(spark, d), names[0], paths[0], buckets=8)
        for _ in range(2):
            scoring.add_predictions(t.issue_predictions(spark, d), names[1], paths[1], buckets=8)
        # the files stay where they are when the names go
        return scoring.unscored(spark, *names).select("id", "title")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


@register
def score_issues(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "issue-predictions")
    scored = classifier.score_issues(
        t.issues(spark, d), t.issue_predictions(spark, d), trained_model(spark, d), AS_OF
    )
    store.append_rows(scored, path)
    return spark.read.parquet(path)


@register
def classify_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = t.issues(spark, d).select("id", "title", "body")
    return classifier.classify_texts(texts, trained_model(spark, d)).select(
        "id", "predicted_label", "confidence"
    )


# --- feeds, tables, maintenance ------------------------------------------------


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@register
def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    return _plain_time(feeds.normalize_events(t.raw_event_feed(spark, d)), "created_at")


@register
def ingest_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _plain_time(
        feeds.normalize_issues(t.raw_issue_feed(spark, d)), "created_at", "closed_at"
    )
    return rows.withColumn("labels", F.array_join("labels", ","))


@register
def rejected_events(spark: SparkSession, d: str) -> DataFrame:
    """What a feed with planted faults loads and rejects: rows by reason."""
    parsed = feeds.parse_events(t.broken_event_feed(spark, d))
    reason = F.coalesce("error", F.lit("loaded")).alias("outcome")
    return parsed.groupBy(reason).agg(F.count("*").alias("events"))


@register
def repository_lookback(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of all repositories; in the first the pages of one are cut off, and the second
    fetches each from its own mark. By repository: events stored by the first load and in all,
    the mark, and how often it was held back."""
    events, log = new_path(spark, "fetched"), new_path(spark, "marks")
    repo = F.coalesce(
        F.get_json_object("value", "$.repo.name"), F.get_json_object("value", "$.repo")
    )
    at = F.get_json_object("value", "$.created_at").cast("timestamp")
    feed = t.raw_event_feed(spark, d).select("value", repo.alias("repo_name"), at.alias("at"))
    cut = F.expr("substr(value, 1, length(value) - 20)")
    value = F.when(F.col("repo_name") == FORECAST_REPO, cut).otherwise(F.col("value"))
    half = "2024-01-15 00:00:00"
    first = feed.where(F.col("at") < F.lit(half).cast("timestamp")).withColumn("value", value)
    lookback.load_fetches(first, events, log, 0, half, days_back=31)
    since = lookback.next_fetches(feed.select("repo_name"), log, AS_OF, days_back=31)
    second = feed.join(since, "repo_name").where("at >= since")
    lookback.load_fetches(second, events, log, 1, AS_OF, days_back=31)

    stored = spark.read.parquet(events).groupBy("repo_name").agg(
        F.count_if(F.col("load_id") == 0).alias("first_load"), F.count("*").alias("events")
    )
    seen = lookback.load_log(spark, log).groupBy("repo_name").agg(
        F.max("mark").cast("timestamp_ntz").alias("mark"),
        F.count_if(F.col("mark").isNull()).alias("held_back"),
    )
    return stored.join(seen, "repo_name")


@register
def rejected_issues(spark: SparkSession, d: str) -> DataFrame:
    parsed = feeds.parse_issues(t.broken_issue_feed(spark, d))
    reason = F.coalesce("error", F.lit("loaded")).alias("outcome")
    return parsed.groupBy(reason).agg(F.count("*").alias("issues"))


def _fetched_issues(spark: SparkSession, d: str) -> DataFrame:
    """The issues of the feed, landed once: the fetches of a query read them from there."""
    path = new_path(spark, "landed-issues")
    fetched = feeds.normalize_issues(t.raw_issue_feed(spark, d))
    fetched.write.parquet(path, compression="zstd")
    return spark.read.schema(fetched.schema).parquet(path)


def _stored_issues(spark: SparkSession, d: str) -> str:
    """Issues fetched three times: all, the closed ones again, and late the first fetch again;
    in the first all were open."""
    path = new_path(spark, "issues")
    fetched = _fetched_issues(spark, d)
    none = F.lit(None).cast("timestamp")
    first = fetched.withColumns({"state": F.lit("open"), "closed_at": none})
    for fetch_id, rows in ((0, first), (1, fetched.where("state = 'closed'")), (0, first)):
        store.store_issues(rows, path, fetch_id, buckets=8)
    return path


@register
def store_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(_stored_issues(spark, d)).select(*feeds.ISSUE_COLUMNS)
    rows = _plain_time(rows, "created_at", "closed_at")
    return rows.withColumn("labels", F.array_join("labels", ","))


@register
def store_issues_on_read(spark: SparkSession, d: str) -> DataFrame:
    """The same fetches kept beside a base table, folded after the second, read after the
    late one."""
    path = new_path(spark, "issue-fetches")
    fetched = _fetched_issues(spark, d)
    first = fetched.withColumns(
        {"state": F.lit("open"), "closed_at": F.lit(None).cast("timestamp")}
    )
    for fetch_id, rows in ((0, first), (1, fetched.where("state = 'closed'"))):
        issue_store.append_fetch(rows, path, fetch_id)
    issue_store.fold_fetches(spark, path, buckets=8)
    issue_store.append_fetch(first, path, 0)
    rows = issue_store.read_issues(spark, path).select(*feeds.ISSUE_COLUMNS)
    rows = _plain_time(rows, "created_at", "closed_at")
    return rows.withColumn("labels", F.array_join("labels", ","))


@register
def export_issues(spark: SparkSession, d: str) -> DataFrame:
    target = new_path(spark, "export")
    issues = t.issues(spark, d)
    store.export_table(issues, target, "json")
    # an empty table is skipped, and the target stays as it was
    store.export_table(issues.where(F.lit(False)), target, "json")
    return spark.read.json(target).groupBy("repo_name", "state").agg(
        F.count("*").alias("issues"), F.count("closed_at").alias("with_end")
    )


@register
def export_forecasts(spark: SparkSession, d: str) -> DataFrame:
    target = new_path(spark, "export")
    store.export_table(spark.read.parquet(_stored_forecasts(spark, d)), target, "json")
    return spark.read.json(target).groupBy("repository").agg(
        F.count("*").alias("days"), F.sum("predicted_events").alias("events")
    )


@register
def export_predictions(spark: SparkSession, d: str) -> DataFrame:
    target = new_path(spark, "export")
    store.export_table(t.issue_predictions(spark, d), target)
    return spark.read.parquet(target)


def _stored_events(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "events")
    store.append_events(t.activity(spark, d), path, backfill=True)
    return path


@register
def append_events(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.read.parquet(_stored_events(spark, d))
    return stored.groupBy(F.col("event_month").cast("bigint")).agg(
        F.count("*").alias("events"), F.count("_inserted_at").alias("stamped")
    )


@register
def export_table(spark: SparkSession, d: str) -> DataFrame:
    target = new_path(spark, "export")
    store.export_table(t.activity(spark, d), target, "orc")
    return spark.read.orc(target)


@register
def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    folder, restored = new_path(spark, "backups"), new_path(spark, "restored")
    stored = spark.read.parquet(_stored_events(spark, d))
    store.restore_table(spark, store.backup_table(stored, folder, AS_OF), restored)
    return spark.read.parquet(restored).select(*feeds.EVENT_COLUMNS)


def _loaded_events(spark: SparkSession, d: str, loads: int = 6) -> str:
    """The events in several loads, an event's load being its id modulo their number."""
    path = new_path(spark, "events")
    for load in range(loads):
        store.append_events(_load(spark, d, load, loads), path, load_id=load)
    return path


def _load(spark: SparkSession, d: str, load: int, loads: int) -> DataFrame:
    return t.activity(spark, d).where(F.col("id").cast("bigint") % loads == load)


@register
def backup_restore_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Backed up, restored twice to a new place, and a load repeated there."""
    folder, restored = new_path(spark, "backups"), new_path(spark, "restored")
    path = _loaded_events(spark, d, 3)
    backup = store.backup_table(spark.read.parquet(path), folder, AS_OF, path)
    for _ in range(2):
        store.restore_table(spark, backup, restored)
    store.append_events(_load(spark, d, 1, 3), restored, load_id=1)
    return spark.read.parquet(restored).select(*feeds.EVENT_COLUMNS)


@register
def compact_then_replay(spark: SparkSession, d: str) -> DataFrame:
    """Crowded months merged in place, then two merged loads repeated."""
    path = _loaded_events(spark, d)
    store.compact_in_place(spark, path, new_path(spark, "staging"))
    for load in (0, 4):
        store.append_events(_load(spark, d, load, 6), path, load_id=load)
    return spark.read.parquet(path).select(*feeds.EVENT_COLUMNS)


@register
def compact_events_then_replay(spark: SparkSession, d: str) -> DataFrame:
    """Compacted to a new place, and a merged load repeated there."""
    target = new_path(spark, "compacted")
    store.compact_events(spark, _loaded_events(spark, d, 3), target)
    store.append_events(_load(spark, d, 1, 3), target, load_id=1)
    return spark.read.parquet(target).select(*feeds.EVENT_COLUMNS)


@register
def compact_restore_replay(spark: SparkSession, d: str) -> DataFrame:
    """Compacted in place, backed up, restored elsewhere and to a place that has the loads as
    they came; a merged load repeated in both, of which the second is returned."""
    path, folder = _loaded_events(spark, d), new_path(spark, "backups")
    other, plain = new_path(spark, "restored"), _loaded_events(spark, d)
    store.compact_in_place(spark, path, new_path(spark, "staging"))
    backup = store.backup_table(spark.read.parquet(path), folder, AS_OF, path)
    for where in (other, plain):
        store.restore_table(spark, backup, where)
        store.append_events(_load(spark, d, 2, 6), where, load_id=2)
    rows = [spark.read.parquet(where).select(*feeds.EVENT_COLUMNS) for where in (other, plain)]
    # what is in one of them alone would make a row more
    return rows[1].unionByName(rows[0].exceptAll(rows[1]))


@register
def delete_by_key_indexed(spark: SparkSession, d: str) -> DataFrame:
    """One repository deleted by the index of keys, with a load that came after indexing."""
    path, index = _loaded_events(spark, d, 2), new_path(spark, "key-index")
    keyindex.index_table(spark, path, index)
    store.append_events(_load(spark, d, 1, 2), path, load_id=1)
    keyindex.delete_keys(spark, path, index, "repo_name", [FORECAST_REPO])
    return spark.read.parquet(path).select(*feeds.EVENT_COLUMNS)


@register
def events_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The events of two repositories and an unknown one, by the index of keys."""
    path, index = _loaded_events(spark, d, 2), new_path(spark, "key-index")
    keyindex.index_table(spark, path, index)
    names = [FORECAST_REPO, "org1/repo5", "no/such"]
    return keyindex.rows_of_keys(spark, path, index, "repo_name", names).select(*feeds.EVENT_COLUMNS)


@register
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    path = _loaded_events(spark, d, 2)
    store.delete_in_place(spark, path, F.col("repo_name") == FORECAST_REPO)
    return spark.read.parquet(path).select(*feeds.EVENT_COLUMNS)


on_events("retention_keep", store.retention_keep, RETENTION_AS_OF)


@register
def retention_in_place(spark: SparkSession, d: str) -> DataFrame:
    path = _stored_events(spark, d)
    store.apply_retention(spark, path, RETENTION_AS_OF)
    return spark.read.parquet(path).select(*feeds.EVENT_COLUMNS)


@register
def compact_events(spark: SparkSession, d: str) -> DataFrame:
    target = new_path(spark, "compacted")
    store.compact_events(spark, _stored_events(spark, d), target)
    return spark.read.parquet(target).select(*feeds.EVENT_COLUMNS)


@register
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    names = ["events", "documents", "labels", "orders", "lineitem"]
    return store.table_sizes(spark, {name: f"{d}/{name}.parquet" for name in names})


@register
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    names = ["events", "documents", "labels", "orders", "lineitem"]
    return store.table_rows(spark, {name: f"{d}/{name}.parquet" for name in names})


@register
def created_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables created, filled by the jobs that load them, and counted by SQL."""
    database, folder = f"created_{uuid4().hex}", new_path(spark, "created")
    schema.create_tables(spark, database, folder)
    try:
        events = t.activity(spark, d)
        store.append_events(events, f"{folder}/events", load_id=0)
        rollup.append_delta(rollup.rollup_delta(events), f"{folder}/daily_summary", load_id=0)
        store.append_forecasts(forecast.forecast_repos(events, AS_OF), f"{folder}/forecasts")
        issues_ = feeds.normalize_issues(t.raw_issue_feed(spark, d))
        store.store_issues(issues_, f"{folder}/issues", 0, buckets=4)
        schema.refresh_tables(spark, database)
        parts = [
            f"SELECT '{name}' AS table, count(*) AS rows, {total} AS total FROM {database}.{name}"
            for name, total in (
                ("events", "count(DISTINCT id)"),
                ("daily_summary", "sum(event_count)"),
                ("forecasts", "count(DISTINCT repository)"),
                ("issues", "count(DISTINCT id)"),
                ("releases", "count(id)"),
            )
        ]
        counted = spark.sql(" UNION ALL ".join(parts)).collect()  # five rows
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(counted, "table string, rows bigint, total bigint")


@register
def thresholds_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "thresholds")
    row = anomalies.dynamic_thresholds(t.activity(spark, d), t.issues(spark, d), AS_OF)
    thresholds.save_thresholds(thresholds.with_stamp(row, AS_OF), path)
    loaded = thresholds.load_thresholds(spark, path)
    return loaded.select(*[F.round(c, 6).alias(c) for c in loaded.columns])


@register
def sql_params(spark: SparkSession, d: str) -> DataFrame:
    return sqlentry.query(
        spark,
        """SELECT repo_name, count(*) AS events FROM {events}
           WHERE type = :type AND created_at >= CAST(:since AS TIMESTAMP_NTZ)
           GROUP BY repo_name""",
        {"type": "PushEvent", "since": RANGE_START},
        {"events": t.activity(spark, d)},
    )


# --- rollup and streams --------------------------------------------------------


def _stored_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The rollup after four loads, an event's load being its id modulo 4."""

    def build(path: str) -> None:
        events = t.activity(spark, d).withColumn("load_id", F.col("id").cast("bigint") % 4)
        rollup.append_delta(rollup.rollup_delta(events, "load_id"), path)

    return spark.read.parquet(_kept(spark, d, "rollup", build))


def _stored_actors(spark: SparkSession, d: str) -> DataFrame:
    """The rollup of actors after four loads."""

    def build(path: str) -> None:
        events = t.activity(spark, d).withColumn("load_id", F.col("id").cast("bigint") % 4)
        rollup.append_delta(actors.actor_delta(events, "load_id"), path)

    return spark.read.parquet(_kept(spark, d, "actors", build))


@register
def developer_velocity_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return actors.velocity_from_rollup(_stored_actors(spark, d), AS_OF)


@register
def community_health_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return actors.health_from_rollup(_stored_actors(spark, d), AS_OF)


@register
def trending_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return actors.trending_from_rollup(_stored_actors(spark, d), AS_OF)


@register
def contributor_flow(spark: SparkSession, d: str) -> DataFrame:
    return actors.contributor_flow(_stored_actors(spark, d), AS_OF)


@register
def daily_rollup_reference(spark: SparkSession, d: str) -> DataFrame:
    return rollup.summed_rollup(_stored_rollup(spark, d))


@register
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.merged_rollup(_stored_rollup(spark, d))


@register
def event_traffic_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return traffic.event_traffic_from_rollup(_stored_rollup(spark, d))


@register
def daily_activity_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return traffic.daily_activity_from_rollup(_stored_rollup(spark, d))


@register
def detailed_analytics_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    return repositories.detailed_analytics_from_rollup(_stored_rollup(spark, d), AS_OF)


@register
def forecast_repos_from_rollup(spark: SparkSession, d: str) -> DataFrame:
    series = forecast.training_series_from_rollup(_stored_rollup(spark, d))
    return forecast.forecast_from_series(series, AS_OF)


@register
def collapse_rollup(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "rollup-collapsed")
    rollup.append_delta(rollup.collapse_rollup(_stored_rollup(spark, d)), path, load_id=0)
    return rollup.merged_rollup(spark.read.parquet(path))


def _landed_feed(spark: SparkSession, d: str) -> str:
    landing = new_path(spark, "landing")
    t.raw_event_feed(spark, d).write.text(landing)
    return landing


def _streamed(spark: SparkSession, d: str) -> dict[str, str]:
    names = ("events", "rollup", "rejected", "checkpoint")
    paths = {name: new_path(spark, f"stream-{name}") for name in names}
    ingest.stream_ingest(
        spark,
        _landed_feed(spark, d),
        paths["events"],
        paths["rollup"],
        paths["rejected"],
        paths["checkpoint"],
    )
    return paths


@register
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.read.parquet(_streamed(spark, d)["events"])
    return _plain_time(stored.select(*feeds.EVENT_COLUMNS), "created_at")


@register
def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.merged_rollup(spark.read.parquet(_streamed(spark, d)["rollup"]))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The activity table as a stream of its files, with the event time as TIMESTAMP."""
    schema = t.read(spark, d, "events").schema
    # a pattern, since a stream takes a folder or a pattern but not one file's name
    files = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return t.as_activity(files).withColumn("created_at", F.col("created_at").cast("timestamp"))


@register
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    path, checkpoint = new_path(spark, "daily-counts"), new_path(spark, "checkpoint")
    collapsed = new_path(spark, "daily-counts-collapsed")
    ingest.stream_daily_counts(_event_stream(spark, d), path, checkpoint, late_by="7 days")
    ingest.collapse_daily_counts(spark, path, collapsed)
    return spark.read.parquet(collapsed)


@register
def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    events = t.activity(spark, d)
    return feeds.dedup_events(events.unionByName(events))


@register
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    path, checkpoint = new_path(spark, "dedup"), new_path(spark, "checkpoint")
    events = _event_stream(spark, d)
    ingest.stream_dedup(events.unionByName(events), path, checkpoint)
    stored = spark.read.parquet(path)
    return _plain_time(stored.select(*feeds.EVENT_COLUMNS), "created_at")


@register
def stream_dedup_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The feed landed and read three times counts once."""
    names = ("events", "rollup", "rejected", "checkpoint")
    paths = [new_path(spark, f"once-{name}") for name in names]
    landing = new_path(spark, "landing")
    feed = t.raw_event_feed(spark, d)
    parts = (feed, feed.where(F.length("value") % 2 == 0), feed)
    for part in parts:
        part.write.mode("append").text(landing)
        ingest.stream_ingest(spark, landing, *paths, once=True)
    return rollup.merged_rollup(spark.read.parquet(paths[1]))


# --- limits that follow the feeds ----------------------------------------------


def _streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of both feeds as a stream keeps them; each event comes twice, the newest
    files first."""

    def build(path: str) -> None:
        landing, raw = new_path(spark, "landed"), new_path(spark, "counts")
        events = limits.event_rows(t.activity(spark, d))
        rows = events.unionByName(limits.issue_rows(t.issues(spark, d)))
        rows.write.parquet(f"{landing}/part=0")
        rows.where("part < 3").write.parquet(f"{landing}/part=1")
        stream = (
            spark.readStream.schema(rows.schema)
            .option("maxFilesPerTrigger", 4)
            .option("latestFirst", True)
            .parquet(f"{landing}/part=*")
        )
        limits.stream_counts(stream, raw, new_path(spark, "checkpoint"))
        limits.daily_totals(spark.read.parquet(raw)).write.parquet(path)

    tables = ("events", "documents", "labels")
    return spark.read.parquet(_kept(spark, d, "day-counts", build, tables))


@register
def stream_thresholds(spark: SparkSession, d: str) -> DataFrame:
    row = limits.limits_from_days(_streamed_days(spark, d), AS_OF)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@register
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    rows = limits.health_from_days(_streamed_days(spark, d), AS_OF_TODAY)
    return rows.withColumns({c: F.round(c, 6) for c in ("current", "threshold")})


@register
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = limits.alerts_from_days(_streamed_days(spark, d), AS_OF)
    return rows.withColumn("threshold", F.round("threshold", 6))
