from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolume.operators import classifier, forecast

ISSUES = "id bigint, title string, body string, labels array<string>"


def series(spark, counts, repo="o/r", first=datetime(2024, 1, 1)):
    """Events with the given count on each day."""
    days = [(repo, first + timedelta(days=d), n) for d, n in enumerate(counts) if n]
    df = spark.createDataFrame(days, "repo_name string, created_at timestamp, n int")
    return df.select("repo_name", "created_at", F.explode(F.sequence(F.lit(1), "n")))


def test_one_day_of_history_is_repeated(spark):
    rows = forecast.forecast_repos(series(spark, [7]), "2024-02-01", 5).collect()
    assert len(rows) == 5
    assert {(r["predicted_events"], r["lower_bound"], r["upper_bound"]) for r in rows} == {(7, 7, 7)}
    assert min(r["forecast_date"] for r in rows) == date(2024, 1, 2)
    assert {(r["model_type"], r["training_date"]) for r in rows} == {("trend_weekly", date(2024, 2, 1))}


def test_a_straight_line_goes_on(spark):
    rows = forecast.forecast_repos(series(spark, range(1, 22)), "2024-02-01", 14).collect()
    found = [r["predicted_events"] for r in sorted(rows, key=lambda r: r["forecast_date"])]
    assert found == [float(n) for n in range(22, 36)]


def test_falling_counts_stop_at_zero(spark):
    rows = forecast.forecast_repos(series(spark, range(20, 0, -1)), "2024-02-01", 30).collect()
    assert min(r["predicted_events"] for r in rows) == 0
    assert all(r["lower_bound"] <= r["predicted_events"] <= r["upper_bound"] for r in rows)


def fit_by_hand(counts, first, periods):
    """The model with numpy: line, weekday means, month means from two years on."""
    days = [first + timedelta(days=d) for d, n in enumerate(counts) if n]
    y = np.array([n for n in counts if n], float)
    x = np.array([(d - days[0]).days for d in days], float)
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - (intercept + slope * x)
    weekday = np.array([d.weekday() for d in days])
    weekly = {w: rest[weekday == w].mean() for w in set(weekday)}
    rest = rest - np.array([weekly[w] for w in weekday])
    month = np.array([d.month for d in days])
    yearly = {}
    if (days[-1] - days[0]).days >= 730:
        yearly = {m: rest[month == m].mean() for m in set(month)}
    rest = rest - np.array([yearly.get(m, 0.0) for m in month])
    out = []
    for k in range(1, periods + 1):
        d = days[-1] + timedelta(days=k)
        at = intercept + slope * (d - days[0]).days
        at += weekly.get(d.weekday(), 0.0) + yearly.get(d.month, 0.0)
        half = 1.959964 * rest.std()
        out.append((d.date(), *[float(int(max(0.0, v))) for v in (at, at - half, at + half)]))
    return out


@pytest.mark.parametrize("days", [40, 800])
def test_forecast_equals_the_model_by_hand(spark, days):
    random = np.random.default_rng(3)
    counts = [int(n) for n in random.integers(0, 15, days) + np.arange(days) // 50]
    first = datetime(2021, 5, 3)
    counts[0] = counts[-1] = 3
    rows = forecast.forecast_repos(series(spark, counts, first=first), "2024-02-01").collect()
    found = sorted(
        (r["forecast_date"], r["predicted_events"], r["lower_bound"], r["upper_bound"]) for r in rows
    )
    assert found == fit_by_hand(counts, first, 30)


def test_repositories_do_not_mix(spark):
    a, b = series(spark, range(5, 40), "a"), series(spark, [9, 1] * 15, "b")
    both = forecast.forecast_repos(a.unionByName(b), "2024-02-01")
    alone = forecast.forecast_repos(a, "2024-02-01").unionByName(
        forecast.forecast_repos(b, "2024-02-01")
    )
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
    only = forecast.forecast_repos(a.unionByName(b), "2024-02-01", repos=["a"])
    assert {r["repository"] for r in only.collect()} == {"a"}


def test_backtest(spark):
    row = forecast.backtest(series(spark, [10] * 31), "2024-02-01").first()
    assert (row["days"], row["mae"], row["coverage"]) == (7, 0.0, 1.0)


def labelled(spark, n=200):
    words = {"bug": "crash error broken", "docs": "manual typo readme"}
    rows = [
        (i, f"issue {i}", f"{words[label]} {['alpha', 'beta', 'gamma'][i % 3]}", [label, "x"])
        for i in range(n)
        for label in [["bug", "docs"][i % 2]]
    ]
    rows.append((n, "rare", "rare", ["rare"]))
    rows.append((n + 1, "none", None, []))
    return spark.createDataFrame(rows, ISSUES)


def test_training_rows_and_classes(spark):
    rows = classifier.training_rows(labelled(spark))
    assert rows.count() == 201
    assert rows.where("id = 0").first()["label"] == "bug"
    assert [tuple(r) for r in classifier.valid_classes(rows).collect()] == [("bug", 100), ("docs", 100)]
    assert classifier.in_valid_classes(rows).where("label = 'rare'").count() == 0


def test_split_is_stable_and_near_its_share(spark):
    rows = spark.range(20000).withColumn("label", F.lit("a"))
    split = classifier.with_split(rows)
    again = classifier.with_split(rows.repartition(9))
    assert split.exceptAll(again).count() == 0
    share = split.where("split = 'test'").count() / 20000
    assert abs(share - 0.2) < 0.01
    other = classifier.with_split(rows, seed=7)
    assert split.exceptAll(other).count() > 0


def test_train_save_load_score(spark, tmp_path):
    issues = labelled(spark)
    rows = classifier.with_split(classifier.in_valid_classes(classifier.training_rows(issues)))
    model = classifier.train(rows.where("split = 'train'"))
    path = str(tmp_path / "model")
    classifier.save_model(model, path)
    loaded = classifier.load_model(path)
    report = classifier.classification_report(
        classifier.predict_split(rows.where("split = 'test'"), loaded)
    )
    found = {r["class"]: r for r in report.collect()}
    assert found["accuracy"]["f1_score"] > 0.95

    predictions = spark.createDataFrame([(0,), (1,), (None,)], "issue_id bigint")
    scored = classifier.score_issues(issues, predictions, loaded, "2024-01-31")
    assert scored.count() == issues.count() - 2
    assert scored.where("confidence <= 0 OR confidence > 1").count() == 0
    assert {r["prediction_date"] for r in scored.collect()} == {date(2024, 1, 31)}
    texts = spark.createDataFrame([("crash", "error broken"), ("typo", None)], "title string, body string")
    labels = [r["predicted_label"] for r in classifier.classify_texts(texts, loaded).collect()]
    assert labels == ["bug", "docs"]


def test_a_prediction_without_issue_id_excludes_nothing(spark):
    issues = labelled(spark, 4)
    predictions = spark.createDataFrame([(1,), (None,)], "issue_id bigint")
    assert classifier.unscored_issues(issues, predictions).count() == 5


def test_report_of_a_class_never_predicted(spark):
    pairs = [("a", "a")] * 3 + [("b", "a")] * 1 + [("a", "c")] * 1
    report = classifier.classification_report(
        spark.createDataFrame(pairs, "label string, prediction string")
    )
    found = {r["class"]: r for r in report.collect()}
    assert (found["a"]["precision"], found["a"]["recall"], found["a"]["support"]) == (0.75, 0.75, 4)
    assert (found["b"]["precision"], found["b"]["recall"], found["b"]["support"]) == (0.0, 0.0, 1)
    assert (found["c"]["precision"], found["c"]["recall"], found["c"]["support"]) == (0.0, 0.0, 0)
    assert found["accuracy"]["f1_score"] == 0.6
    assert found["macro avg"]["precision"] == 0.25
    assert found["weighted avg"]["recall"] == 0.6


def test_backtest_keeps_a_repository_that_was_quiet(spark):
    counts = [5] * 8 + [0] * 19 + [5]
    both = series(spark, counts).unionByName(series(spark, [3] * 30, "o/steady"))
    rows = {r["repository"]: r for r in forecast.backtest(both, "2024-01-31").collect()}
    assert rows["o/r"]["days"] == 1 and rows["o/r"]["mae"] == 0.0
    assert rows["o/steady"]["days"] == 7
    # no hold-out day had events
    quiet = forecast.backtest(series(spark, [5] * 8), "2024-01-31").first()
    assert (quiet["days"], quiet["mae"], quiet["coverage"]) == (0, None, None)


def test_yearly_term_as_told(spark):
    data = forecast.training_series(series(spark, [4 + d % 3 for d in range(60)]))
    used = {y: forecast.fit(data, y).first()["has_years"] for y in (True, False, "auto")}
    assert used == {True: True, False: False, "auto": False}


def test_no_job_runs_while_the_classes_are_joined(spark):
    rows = spark.createDataFrame([(1, "x", "a")], "id bigint, text string, label string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    classifier.in_valid_classes(rows, 1)
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)
