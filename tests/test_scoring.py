import contextlib
import io
import re
from uuid import uuid4

import pytest

from repolume.sources import scoring


@pytest.fixture
def place(spark, tmp_path):
    """Names and paths of the two tables, in a database of their own."""
    database = f"scoring_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    yield [(f"{database}.{name}", str(tmp_path / name)) for name in ("issues", "predictions")]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def issues(spark, n):
    return spark.range(n).selectExpr("id", "concat('title ', id) AS title", "repeat('x', 50) AS body")


def predictions(spark, ids):
    rows = [(i, "bug", 0.5) for i in ids]
    return spark.createDataFrame(rows, "issue_id long, predicted_label string, confidence double")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_unscored_without_a_shuffle_of_texts(spark, place, broadcast):
    (names, issue_path), (scores, score_path) = place
    scoring.store_scorable(issues(spark, 500), names, issue_path, buckets=4)
    scoring.add_predictions(predictions(spark, [*range(0, 500, 2), None]), scores, score_path, 4)
    scoring.add_predictions(predictions(spark, [1, 3]), scores, score_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left = scoring.unscored(spark, names, scores)
        text = plan(left)
        assert ids(left) == list(range(5, 500, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in text and "SelectedBucketsCount: 4 out of 4" in text
    if broadcast == "-1":
        assert "Exchange" not in text and re.search("SortMergeJoin|ShuffledHashJoin", text)


def test_repeated_loads_add_nothing(spark, place):
    (names, issue_path), (scores, score_path) = place
    scoring.store_scorable(issues(spark, 40), names, issue_path, buckets=3)
    for _ in range(2):
        scoring.add_predictions(predictions(spark, range(30)), scores, score_path, buckets=3)
    assert spark.table(scores).count() == 30
    assert ids(scoring.unscored(spark, names, scores)) == list(range(30, 40))
    # issues fetched anew replace the table; what was scored stays scored
    scoring.store_scorable(issues(spark, 50), names, issue_path, buckets=3)
    assert ids(scoring.unscored(spark, names, scores)) == list(range(30, 50))


def test_other_bucket_counts_are_refused(spark, place):
    (names, issue_path), (scores, score_path) = place
    scoring.store_scorable(issues(spark, 10), names, issue_path, buckets=3)
    scoring.add_predictions(predictions(spark, [1]), scores, score_path, buckets=2)
    with pytest.raises(ValueError, match="different"):
        scoring.unscored(spark, names, scores)
    assert scoring.bucket_count(spark, scores) == 2


def test_empty_tables(spark, place):
    (names, issue_path), (scores, score_path) = place
    scoring.store_scorable(issues(spark, 0), names, issue_path, buckets=2)
    scoring.add_predictions(predictions(spark, []), scores, score_path, buckets=2)
    assert ids(scoring.unscored(spark, names, scores)) == []
