"""Marks of each repository: moved by committed loads alone, one failure holds back only itself."""

import json
from datetime import datetime

import pytest

from repolume.sources import lookback

FETCH = "repo_name string, value string"


def event(n, repo, at):
    return {
        "id": str(n), "type": "PushEvent", "actor": {"login": "dev"}, "repo": {"name": repo},
        "created_at": at, "payload": {},
    }


def page(repo, *events):
    return (repo, json.dumps([event(n, repo, at) for n, at in events]))


@pytest.fixture()
def load(spark, tmp_path):
    def run(pages, load_id, as_of="2024-01-10 00:00:00"):
        fetches = spark.createDataFrame(pages, FETCH)
        paths = str(tmp_path / "events"), str(tmp_path / "marks")
        log = lookback.load_fetches(fetches, *paths, load_id, as_of)
        return {r.repo_name: (r.loaded, r.rejected, r.mark) for r in log.collect()}

    def stored():
        rows = spark.read.parquet(str(tmp_path / "events")).collect()
        return sorted((r.repo_name, int(r.id)) for r in rows)

    def since(as_of):
        repos = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "name string")
        rows = lookback.next_fetches(repos, str(tmp_path / "marks"), as_of).collect()
        return {r.repo_name: r.since for r in rows}

    return run, stored, since


def test_one_failure_holds_back_only_itself(load):
    run, stored, since = load
    good = page("a", (1, "2024-01-09T10:00:00Z"), (2, "2024-01-09T12:00:00Z"))
    half = page("b", (3, "2024-01-09T10:00:00Z"))
    cut = ("b", '[{"id": "4", "type": "Pu')
    first = run([good, half, cut, ("c", None)], 0)
    assert first == {
        "a": (2, 0, datetime(2024, 1, 9, 12)), "b": (0, 1, None), "c": (0, 1, None),
    }
    assert stored() == [("a", 1), ("a", 2)]
    # a goes on from its mark, less the hour in which late events come; b and c from the start
    assert since("2024-01-11 00:00:00") == {
        "a": datetime(2024, 1, 9, 11), "b": datetime(2024, 1, 4), "c": datetime(2024, 1, 4),
    }

    # the next run closes the gap of b; a repeats its last hour, whose events are not doubled
    again = page("a", (2, "2024-01-09T12:00:00Z"), (5, "2024-01-09T11:30:00Z"))
    whole = page("b", (3, "2024-01-09T10:00:00Z"), (4, "2024-01-09T11:00:00Z"))
    second = run([again, whole, page("c")], 1, "2024-01-11 00:00:00")
    assert second == {
        "a": (2, 0, datetime(2024, 1, 9, 12)), "b": (2, 0, datetime(2024, 1, 9, 11)),
    }
    assert stored() == [("a", 1), ("a", 2), ("a", 5), ("b", 3), ("b", 4)]
    assert since("2024-01-11 00:00:00")["b"] == datetime(2024, 1, 9, 10)


def test_a_gap_longer_than_the_look_back_is_closed(load):
    run, stored, since = load
    run([page("a", (1, "2024-01-09T10:00:00Z"))], 0)
    assert since("2024-03-01 00:00:00")["a"] == datetime(2024, 1, 9, 9)
    run([page("a", (2, "2024-01-15T00:00:00Z"))], 1, "2024-03-01 00:00:00")
    assert stored() == [("a", 1), ("a", 2)]


def test_a_repeated_load_replaces_itself(load):
    run, stored, _ = load
    pages = [page("a", (1, "2024-01-09T10:00:00Z"), (2, "2024-01-09T14:00:00Z"))]
    # as after a run that was lost between the events and the marks, or after both
    assert run(pages, 0) == run(pages, 0) == {"a": (2, 0, datetime(2024, 1, 9, 14))}
    assert stored() == [("a", 1), ("a", 2)]


def test_events_before_the_look_back_are_left_out(load):
    run, stored, _ = load
    run([page("a", (1, "2023-12-01T10:00:00Z"), (2, "2024-01-09T14:00:00Z"))], 0)
    assert stored() == [("a", 2)]
