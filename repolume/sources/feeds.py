"""The two nested JSON feeds, flattened to table rows.

Input is a DataFrame with a text column ``value``: one JSON object per row, or
one page (a JSON array of objects) per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.schema import ISSUE_FEED

_EVENT_FEED = (
    "id STRING, type STRING, actor STRING, repo STRING, created_at STRING, "
    "payload STRING, org STRING"
)
EVENT_COLUMNS = [
    "id", "type", "actor_login", "repo_name", "created_at", "payload", "org_login",
]
ISSUE_COLUMNS = [
    "id", "number", "title", "body", "labels", "state", "created_at", "closed_at",
    "user_login", "repo_name",
]


def feed_items(raw: DataFrame) -> DataFrame:
    """One JSON object per row, whether a row held an object or a page of them.

    A page that cannot be read stays as it is: a row whose ``value`` begins with ``[``.
    """
    page = F.ltrim(F.col("value")).startswith("[")
    whole = F.array("value")
    items = F.when(page, F.coalesce(F.from_json("value", "array<string>"), whole)).otherwise(whole)
    others = [c for c in raw.columns if c != "value"]
    return raw.select(*others, F.explode(items).alias("value"))


def _unreadable() -> Column:
    """Why a row is no JSON object: part of a page, or no JSON; NULL if it is one."""
    return F.when(F.ltrim(F.col("value")).startswith("["), F.lit("page")).when(
        F.json_object_keys("value").isNull(), F.lit("json")
    )


def iso_time(text: Column) -> Column:
    """ISO 8601 text to a timestamp; text without a zone means UTC, and text that
    is no time becomes NULL."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def _name_of(value: Column, key: str) -> Column:
    """A member that is either a plain string or an object holding the name."""
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{key}")).otherwise(value)


def _parsed(df: DataFrame, struct: Column, *keep: str) -> DataFrame:
    """The members of a computed struct as columns, computed once per row: a
    later filter on them is not rewritten into the computation, as it would be
    for a plain projection."""
    return df.select(*keep, F.inline(F.array(struct)))


def parse_events(raw: DataFrame, *keep: str) -> DataFrame:
    """Every feed row with its table columns and ``error``: the first missing or
    unreadable required member, NULL for a good row. ``keep`` names further columns of
    ``raw`` to keep."""
    members = _parsed(feed_items(raw), F.from_json("value", _EVENT_FEED), "value", *keep)
    no_org = F.col("org").isNull() | F.col("org").isin("", "{}")
    columns = F.struct(
        "id",
        "type",
        _name_of(F.col("actor"), "login").alias("actor_login"),
        _name_of(F.col("repo"), "name").alias("repo_name"),
        iso_time(F.col("created_at")).alias("created_at"),
        F.coalesce("payload", F.lit("{}")).alias("payload"),
        F.when(~no_org, _name_of(F.col("org"), "login")).alias("org_login"),
        (~no_org).alias("has_org"),
    )
    flat = _parsed(members, columns, "value", *keep)
    required = [
        ("id", "id"),
        ("type", "type"),
        ("actor_login", "actor"),
        ("repo_name", "repo"),
        ("created_at", "created_at"),
    ]
    error = F.coalesce(
        F.when(F.ltrim(F.col("value")).startswith("["), F.lit("page")),
        *[F.when(F.col(column).isNull(), member) for column, member in required],
        F.when(F.json_object_keys("value").isNull(), F.lit("json")),
        F.when(~F.col("payload").startswith("{"), "payload"),
        F.when(F.col("has_org") & F.col("org_login").isNull(), "org"),
    )
    return flat.withColumn("error", error).drop("has_org")


def normalize_events(raw: DataFrame) -> DataFrame:
    """The good rows of the event feed as table rows."""
    return parse_events(raw).where("error IS NULL").select(*EVENT_COLUMNS)


def rejected_events(raw: DataFrame) -> DataFrame:
    """The rows of the event feed that cannot be loaded, and why."""
    return parse_events(raw).where("error IS NOT NULL").select("value", "error")


def parse_issues(raw: DataFrame, repo: str | None = None) -> DataFrame:
    """Every element of the issue feed that is no pull request, with its table columns and
    ``error``: why it cannot be loaded, NULL for a good row.

    The feed does not name its repository: give ``repo``, or a ``repo_name``
    column beside ``value``.
    """
    items = feed_items(raw if repo is None else raw.withColumn("repo_name", F.lit(repo)))
    is_pull_request = F.array_contains(F.json_object_keys("value"), "pull_request")
    issues = items.where(~F.coalesce(is_pull_request, F.lit(False))).withColumn(
        "unreadable", _unreadable()
    )
    members = _parsed(
        issues, F.from_json("value", ISSUE_FEED), "value", "repo_name", "unreadable"
    ).withColumnsRenamed({"created_at": "created", "closed_at": "closed"})
    names = F.transform("labels", lambda label: label["name"])
    flat = members.select(
        "value",
        "unreadable",
        "closed",
        "id",
        "number",
        "title",
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce(names, F.array().cast("array<string>")).alias("labels"),
        "state",
        iso_time(F.col("created")).alias("created_at"),
        iso_time(F.col("closed")).alias("closed_at"),
        F.col("user.login").alias("user_login"),
        "repo_name",
    )
    error = F.coalesce(
        "unreadable",
        *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("id", "created_at", "repo_name")],
        F.when(F.col("closed").isNotNull() & F.col("closed_at").isNull(), F.lit("closed_at")),
    )
    return flat.withColumn("error", error).drop("unreadable", "closed")


def normalize_issues(raw: DataFrame, repo: str | None = None) -> DataFrame:
    """The good rows of the issue feed as table rows, without pull requests."""
    return parse_issues(raw, repo).where("error IS NULL").select(*ISSUE_COLUMNS)


def rejected_issues(raw: DataFrame, repo: str | None = None) -> DataFrame:
    """The rows of the issue feed that cannot be loaded, and why."""
    return parse_issues(raw, repo).where("error IS NOT NULL").select("value", "error")


# What makes two rows one event, in batches and in streams: a copy has the time of its first.
EVENT_KEY = ("id", "created_at")


def dedup_events(events: DataFrame, *key: str) -> DataFrame:
    """One row per key (``EVENT_KEY`` if none is given): the earliest, ties broken by the
    other columns.

    A repeated load brings the same event again. Rank 1 of a window is limited
    within each task before the shuffle, so an id that holds very many rows
    sends one row per task.
    """
    key = key or EVENT_KEY
    others = [c for c in events.columns if c not in (*key, "created_at")]
    w = Window.partitionBy(*key).orderBy("created_at", *others)
    return events.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
