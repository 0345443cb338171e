"""Time expressions and the filters most operators begin with."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = datetime | date | str

# The columns whose month is the partition column of the tables that have one.
PARTITION_TIMES = ("created_at", "date")


def as_datetime(value: AsOf) -> datetime:
    """A reference time given as text, date or datetime, as a naive UTC datetime."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = (value - value.utcoffset()).replace(tzinfo=None)
    return value


def from_micros(micros: int) -> datetime:
    """Microseconds since 1970 as a naive UTC datetime."""
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def start_of_day(value: AsOf) -> datetime:
    return as_datetime(value).replace(hour=0, minute=0, second=0, microsecond=0)


def days_before(as_of: AsOf, days: int) -> datetime:
    return as_datetime(as_of) - timedelta(days=days)


def time_literal(df: DataFrame, column: str, value: AsOf) -> Column:
    """``value`` as a literal of the column's own type.

    Comparing a TIMESTAMP_NTZ column with a TIMESTAMP literal casts the column,
    and a cast column is no longer pushed into the parquet scan.
    """
    kind = df.schema[column].dataType
    text = as_datetime(value).isoformat(sep=" ")
    if isinstance(kind, T.TimestampType):
        text += "+00:00"
    return F.lit(text).cast(kind)


def month_key(ts: Column) -> Column:
    """Year and month as one integer (202401), the partition key of the fact table."""
    return F.year(ts) * 100 + F.month(ts)


def _month_number(value: datetime) -> int:
    return value.year * 100 + value.month


def from_time(
    df: DataFrame, start: AsOf, column: str = "created_at", strict: bool = False
) -> DataFrame:
    """Rows at or after ``start`` (after it, if ``strict``); later rows have no limit.

    Spark does not derive a partition predicate from a timestamp predicate, so
    the month condition is added where the table has that partition column.
    """
    start = as_datetime(start)
    edge = time_literal(df, column, start)
    condition = F.col(column) > edge if strict else F.col(column) >= edge
    if column in PARTITION_TIMES and "event_month" in df.columns:
        condition &= F.col("event_month") >= _month_number(start)
    return df.where(condition)


def last_days(
    df: DataFrame, as_of: AsOf, days: int, column: str = "created_at", strict: bool = False
) -> DataFrame:
    return from_time(df, days_before(as_of, days), column, strict)


def in_range(
    df: DataFrame,
    start: AsOf | None = None,
    end: AsOf | None = None,
    column: str = "created_at",
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; ``None`` leaves a side open."""
    if start is not None:
        df = from_time(df, start, column)
    if end is not None:
        end = as_datetime(end)
        df = df.where(F.col(column) <= time_literal(df, column, end))
        if column in PARTITION_TIMES and "event_month" in df.columns:
            df = df.where(F.col("event_month") <= _month_number(end))
    return df


def in_repos(
    df: DataFrame, repos: list[str] | DataFrame | None = None, column: str = "repo_name"
) -> DataFrame:
    """Keep some repositories: a short list becomes a pushed-down IN, a DataFrame
    (first column) a semi join, ``None`` keeps all."""
    if repos is None:
        return df
    if isinstance(repos, DataFrame):
        wanted = repos.select(F.col(repos.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(repos)))


def day(ts: Column) -> Column:
    return F.to_date(ts)


def week_number(d: Column) -> Column:
    """Week of the year, weeks beginning on Sunday, 0 to 53 (days before the
    first Sunday are week 0)."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def week_start(d: Column) -> Column:
    """The Sunday a date's week begins on."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def hours_crossed(start: Column, end: Column) -> Column:
    """How many hour boundaries lie between two times: 00:59 to 01:01 is 1."""
    return F.floor(F.unix_timestamp(end) / 3600) - F.floor(F.unix_timestamp(start) / 3600)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def truncate_to(unit: str, df: DataFrame, column: str) -> Column:
    """``date_trunc`` that keeps the column's own timestamp type."""
    return F.date_trunc(unit, F.col(column)).cast(df.schema[column].dataType)
