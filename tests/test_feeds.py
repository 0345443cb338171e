import json
from datetime import datetime

from pyspark.sql import functions as F

from repolume.operators import delivery
from repolume.sources import feeds


def event(**changes):
    base = {
        "id": "1",
        "type": "PushEvent",
        "actor": {"login": "ann"},
        "repo": {"name": "o/r"},
        "created_at": "2024-01-02T03:04:05Z",
        "payload": {"push_id": 7},
        "org": None,
    }
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "absent"})


def raw(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def test_nested_event(spark):
    row = feeds.normalize_events(raw(spark, event(org={"login": "o"}))).first()
    assert row["id"] == "1" and row["type"] == "PushEvent"
    assert row["actor_login"] == "ann" and row["repo_name"] == "o/r"
    assert row["created_at"] == datetime(2024, 1, 2, 3, 4, 5)
    assert row["payload"] == '{"push_id":7}' and row["org_login"] == "o"


def test_members_may_be_plain_strings(spark):
    row = feeds.normalize_events(raw(spark, event(actor="ann", repo="o/r", org="o"))).first()
    assert (row["actor_login"], row["repo_name"], row["org_login"]) == ("ann", "o/r", "o")


def test_payload_defaults_to_an_empty_object_and_org_to_null(spark):
    row = feeds.normalize_events(raw(spark, event(payload="absent", org="absent"))).first()
    assert row["payload"] == "{}" and row["org_login"] is None
    for empty in ("", {}):
        assert feeds.normalize_events(raw(spark, event(org=empty))).first()["org_login"] is None


def test_times_with_and_without_zone(spark):
    texts = ["2024-01-02T03:04:05", "2024-01-02T05:04:05+02:00", "2024-01-02T03:04:05Z"]
    rows = feeds.normalize_events(raw(spark, *[event(created_at=x) for x in texts])).collect()
    assert {r["created_at"] for r in rows} == {datetime(2024, 1, 2, 3, 4, 5)}


def test_bad_rows_are_set_apart_with_the_reason(spark):
    bad = {
        "id": event(id="absent"),
        "type": event(type="absent"),
        "actor": event(actor={"name": "ann"}),
        "repo": event(repo="absent"),
        "created_at": event(created_at="yesterday"),
        "payload": event(payload="text"),
        "org": event(org={"id": 1}),
    }
    feed = raw(spark, event(), *bad.values())
    assert feeds.normalize_events(feed).count() == 1
    found = {(r["value"], r["error"]) for r in feeds.rejected_events(feed).collect()}
    assert found == {(text, reason) for reason, text in bad.items()}
    assert feeds.rejected_events(raw(spark, "{not json")).first()["error"] == "id"


def test_pages_of_events(spark):
    page = "[" + event(id="1") + "," + event(id="2") + "]"
    ids = [r["id"] for r in feeds.normalize_events(raw(spark, page, event(id="3"))).collect()]
    assert sorted(ids) == ["1", "2", "3"]


def issue(**changes):
    base = {
        "id": 5,
        "number": 1,
        "title": "t",
        "body": None,
        "labels": [{"name": "bug", "color": "red"}, {"name": "ui"}],
        "state": "closed",
        "created_at": "2024-01-02T03:04:05Z",
        "closed_at": None,
        "user": {"login": "ann"},
    }
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "absent"})


def test_issues(spark):
    feed = raw(
        spark,
        issue(),
        issue(id=6, labels=[], closed_at="2024-01-03T00:00:00Z", body="b"),
        issue(id=7, pull_request={"url": "x"}),
        issue(id=8, pull_request=None),
        issue(id=9, labels="absent"),
    )
    rows = {r["id"]: r for r in feeds.normalize_issues(feed, "o/r").collect()}
    assert set(rows) == {5, 6, 9}
    assert rows[5]["labels"] == ["bug", "ui"] and rows[5]["body"] == ""
    assert rows[5]["closed_at"] is None and rows[5]["repo_name"] == "o/r"
    assert rows[6]["labels"] == [] and rows[6]["closed_at"] == datetime(2024, 1, 3)
    assert rows[9]["labels"] == []


def test_merge_times_that_cannot_be_read_are_left_out(spark):
    payloads = [
        '{"merged":true,"pull_request":{"merged_at":"2024-01-01T05:00:00Z"}}',
        '{"merged":true}',
        '{"merged":true,"pull_request":{"merged_at":""}}',
        '{"merged":true,"pull_request":{"merged_at":"soon"}}',
        '{"merged":false,"pull_request":{"merged_at":"2024-01-01T03:00:00Z"}}',
    ]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string").select(
        F.lit("PullRequestEvent").alias("type"),
        F.lit("o/r").alias("repo_name"),
        F.lit("2024-01-01 01:30:00").cast("timestamp").alias("created_at"),
        "payload",
    )
    assert delivery.lead_time_hours(df, "2024-01-31").first()["lead_time"] == 3.0
    assert delivery.deployment_count(df, "2024-01-05").first()["deployments"] == 5
    none = df.where(F.lit(False))
    assert delivery.lead_time_hours(none, "2024-01-31").first()["lead_time"] == 0.0
    assert delivery.lead_time_hours(none, "2024-01-31", by_repo=True).count() == 0


def test_dedup_keeps_the_earliest_whatever_the_partitioning(spark):
    rows = [(str(i % 10), f"2024-01-{1 + i % 28:02d} 00:00:00", i) for i in range(280)]
    df = spark.createDataFrame(rows, "id string, t string, n int").withColumn(
        "created_at", F.col("t").cast("timestamp")
    )
    expected = sorted(tuple(r) for r in feeds.dedup_events(df, "id").collect())
    assert len(expected) == 10
    for parts in (1, 7, 50):
        again = feeds.dedup_events(df.repartition(parts), "id").collect()
        assert sorted(tuple(r) for r in again) == expected


def outcomes(parsed):
    return sorted((r["value"], r["error"] or "") for r in parsed.select("value", "error").collect())


def test_no_event_row_is_lost(spark):
    good = [event(id=str(i)) for i in range(3)]
    cut_page = "[" + good[0] + "," + good[1][:-9]
    texts = [cut_page, "[" + ",".join(good) + "]", "[]", good[2][:-9], "", None, "[[1]]", "[5]"]
    parsed = feeds.parse_events(raw(spark, *texts))
    errors = sorted(r["error"] for r in parsed.where("error IS NOT NULL").collect())
    assert parsed.where("error IS NULL").count() == 3
    # one row of each unreadable text, and none of the empty page
    assert len(errors) == 6 and errors.count("page") == 2
    assert feeds.rejected_events(raw(spark, cut_page)).first()["value"] == cut_page


def test_no_issue_row_is_lost(spark):
    bad = {
        "json": issue()[:-9],
        "id": issue(id="text"),
        "created_at": issue(created_at="soon"),
        "closed_at": issue(closed_at="never"),
        "page": "[" + issue() + "," + issue()[:-9],
    }
    feed = raw(spark, issue(), issue(pull_request={"url": "x"}), *bad.values())
    found = {r["error"]: r["value"] for r in feeds.rejected_issues(feed, "o/r").collect()}
    assert found == bad
    assert feeds.normalize_issues(feed, "o/r").count() == 1
    nowhere = feed.withColumn("repo_name", F.lit(None).cast("string"))
    assert feeds.normalize_issues(nowhere).count() == 0
    assert feeds.rejected_issues(nowhere).count() == 6
