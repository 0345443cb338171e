import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from repolume.operators import delivery
from repolume.sources import payloads

AS_OF = "2024-03-01 00:00:00"
PAYLOADS = [
    '{"action":"closed","merged":true,"pull_request":{"merged_at":"2024-02-11T10:00:00Z"}}',
    '{"action":"closed","merged":true,"pull_request":{"merged_at":null}}',
    '{"action":"closed","merged":true,"pull_request":{"merged_at":"no time"}}',
    '{"merged":true,"pull_request":{"merged_at":{"a":1}}}',
    '{"merged":true,"pull_request":[1]}',
    '{"merged":true,"pull_request":{"merged_at":"2024-02-12"}}',
    '{"title":"not merged, a bug"}',
    "{}",
    None,
]
# (payload, error): none of these has a merge time, however it is read
BAD = [
    ('{"merged":true,"pull_request":', "json"),
    ("", "json"),
    ('["merged"]', "object"),
    ('"merged bug"', "object"),
    ("null", "object"),
    ('{"merged":1,"merged":2}', "json"),
]


def events(spark, payload_texts, copies=3):
    rows = []
    for i, text in enumerate(list(payload_texts) * copies):
        kind = ["PullRequestEvent", "IssuesEvent", "PushEvent"][0 if i % 4 else i // 4 % 3]
        at = dt.datetime(2024, 1, 20) + dt.timedelta(hours=13 * i)
        rows.append((str(i), kind, f"dev{i % 3}", f"r{i % 2}", at, text, None))
    return spark.createDataFrame(
        rows,
        "id string, type string, actor_login string, repo_name string, created_at timestamp, "
        "payload string, org_login string",
    )


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


REPORTS = [
    lambda e: delivery.lead_time_hours(e, AS_OF, by_repo=True),
    lambda e: delivery.deployment_count(e, AS_OF, 60, by_repo=True),
    lambda e: delivery.deployment_frequency_weekly(e, AS_OF),
    lambda e: delivery.change_failure_rate(e, AS_OF, 60, by_repo=True),
]


@pytest.mark.parametrize("report", REPORTS)
@pytest.mark.parametrize("bad", [False, True])
def test_stored_members_give_the_same_reports(spark, tmp_path, report, bad):
    data = events(spark, PAYLOADS + ([b for b, _ in BAD] if bad else []))
    payloads.append_parsed(data, str(tmp_path / "t"), load_id=0)
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = report(stored)
    assert rows(found) == rows(report(data)) != []
    text = plan(found)
    assert "get_json_object" not in text and "parse_json" not in text
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("payload:" not in s and payloads.DATA not in s for s in schemas)


def test_bad_payloads_are_told_apart_and_kept(spark, tmp_path):
    data = events(spark, PAYLOADS + [b for b, _ in BAD], copies=1)
    for _ in range(2):  # a repeated load replaces itself
        payloads.append_parsed(data, str(tmp_path / "t"), load_id=7)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == data.count()
    found = [(r.payload, r.error) for r in payloads.unreadable(stored).collect()]
    assert sorted(found) == sorted(BAD)
    assert rows(stored.select("id", "payload")) == rows(data.select("id", "payload"))


def test_members_of_the_variant(spark, tmp_path):
    data = events(spark, ['{"size":3}', '{"size":"x"}', '{"a":{"b":[5]}}', "[1]", None], copies=1)
    payloads.append_parsed(data, str(tmp_path / "t"), load_id=0)
    stored = spark.read.parquet(str(tmp_path / "t")).select(
        "id",
        payloads.member("$.size", "bigint").alias("size"),
        payloads.member("$.a.b[0]", "int").alias("b"),
    )
    assert rows(stored) == [
        ("0", 3, None), ("1", None, None), ("2", None, 5), ("3", None, None), ("4", None, None)
    ]


def test_no_events(spark):
    empty = payloads.with_members(events(spark, PAYLOADS).where(F.lit(False)))
    assert payloads.unreadable(empty).count() == 0
    assert delivery.lead_time_hours(empty, AS_OF).collect()[0][0] == 0.0
