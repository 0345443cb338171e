"""Event payloads parsed once, when the events are stored.

Beside its text a payload is kept as a VARIANT, from which any member can be read without
parsing the text again, and the members that reports ask for most are columns of their own.
Reports of deployments, lead time and failures then read a few narrow columns, and neither
the text nor the variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolume.sources.tables import append_events

DATA, ERROR = "payload_data", "payload_error"
MERGED_AT, SAYS_MERGED, SAYS_BUG = "payload_merged_at", "payload_says_merged", "payload_says_bug"


def with_members(events: DataFrame) -> DataFrame:
    """The events, and of each payload: its VARIANT, why it can't be read, the time of the
    merge, and whether its text mentions ``merged`` and ``bug``, whatever their value.

    A payload that is no JSON, or that names a member of an object twice, has the error
    ``json``, one that is no object ``object``; its variant and its merge time are NULL. A NULL
    payload has no error. Rows are never lost.
    """
    parsed = events.withColumn(DATA, F.try_parse_json("payload"))
    is_object = F.schema_of_variant(DATA).startswith("OBJECT")
    error = F.when(F.col("payload").isNotNull() & F.col(DATA).isNull(), F.lit("json")).when(
        F.col("payload").isNotNull() & ~is_object, F.lit("object")
    )
    merged = F.try_variant_get(F.col(DATA), "$.pull_request.merged_at", "string")
    return parsed.withColumns(
        {
            ERROR: error,
            MERGED_AT: merged.try_cast(events.schema["created_at"].dataType),
            SAYS_MERGED: F.col("payload").contains("merged"),
            SAYS_BUG: F.col("payload").contains("bug"),
        }
    ).withColumn(DATA, F.when(F.col(ERROR).isNull(), F.col(DATA)))


def append_parsed(
    events: DataFrame, path: str, load_id: int | None = None, backfill: bool = False
) -> None:
    """``append_events`` with the members of ``with_members``: a repeated load replaces itself."""
    append_events(with_members(events), path, load_id, backfill)


def member(path: str, kind: str) -> Column:
    """A member of the stored variant, such as ``$.size``; NULL if it is absent or of another
    kind."""
    return F.try_variant_get(F.col(DATA), path, kind)


def unreadable(stored: DataFrame) -> DataFrame:
    """id, payload and error of the events whose payload can't be read."""
    return stored.where(F.col(ERROR).isNotNull()).select("id", "payload", F.col(ERROR).alias("error"))
