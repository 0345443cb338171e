"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.workers import ship
from repolume.workspace import new_path

# The six white-space characters that part words: \x20 and \x09 to \x0D. These are
# the ones that bytes.split() without arguments parts at.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(
    spark: SparkSession, df: DataFrame, name: str, compression: str | None = None
) -> DataFrame:
    """The rows of ``df``, kept as a table in the shared folder: computed once, and safe
    from the loss of an executor."""
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_swept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """As ``written``, and the shuffle files of the write are removed when it has ended, not
    when the driver next collects its garbage: for chains of tables that would fill the disks.
    The setting of the session is put back."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        return written(spark, df, name)
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(
        F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds), F.lit(-1)
    )


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """One row per document: doc_id, label (the larger, if several disagree)."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(name).cast("int").alias("label"))
    )


def bounded_rows(rows: DataFrame, label: str, most: dict) -> DataFrame:
    """Rows (doc_id, label), at most ``most[value]`` of each value, chosen by a hash of the id."""
    parts = [
        rows.where(F.col(label) == F.lit(value))
        .select("doc_id", F.col(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(n)
        for value, n in most.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_texts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the chosen documents. ``chosen`` comes from ``bounded_rows``,
    so its size has a bound and it may be broadcast. Of repeated ids the smallest text counts."""
    return (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``; a worker that has ended a task gives the memory back that it has freed."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hands freed memory to the system. Idle workers stay beside the executor for a minute, with
    all that they have not handed back, while stages without Python run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


PIECE_BYTES = 1 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes, one row at least. A batch has up to 10,000
    rows however long, and as Python objects they would take their size once more."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_KEPT: dict = {}


def worker_state(key: str, build: Callable):
    """``build()`` once in each Python worker and key; only the newest few keys are kept."""
    if key not in _KEPT:
        while len(_KEPT) >= 2:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = build()
    return _KEPT[key]
