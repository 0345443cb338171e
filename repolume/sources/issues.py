"""Issues merged on read: fetches are kept beside a base table, and folded into it at times.

    base/generation=N/bucket=B   one row per id, with the fetch that it came from
    fetches/fetch_id=N           the rows of one fetch

A fetch writes its own rows and nothing else. Readers take, of each id, the row of the latest
fetch: the base as it is but for the ids that the fetches bring, and of those the newest.
Folding writes the next generation of the base, then removes the fetches that it holds and
the generation before. A generation counts once its writing has succeeded, and what it holds
reads the same from the fetches, so folding can be cut off at any point and repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.sources.tables import (
    PIECE_ROWS,
    delete_folder,
    file_exists,
    folders,
    newest_rows,
    table_exists,
)

FETCH = "fetch_id"
BUCKETS = 64
FOLD_SHARE = 0.2  # of the base's rows, beyond which fetches are folded


def append_fetch(issues: DataFrame, path: str, fetch_id: int) -> None:
    """Store the rows of a fetch; a repeated fetch replaces its own."""
    issues.sortWithinPartitions("id").write.mode("overwrite").parquet(
        f"{path}/fetches/{FETCH}={fetch_id}"
    )


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The base's generations that were written whole, in order."""
    names = [n for n in folders(spark, f"{path}/base") if n.startswith("generation=")]
    whole = [n for n in names if file_exists(spark, f"{path}/base/{n}/_SUCCESS")]
    return sorted(int(n.partition("=")[2]) for n in whole)


def _base(spark: SparkSession, path: str) -> DataFrame | None:
    generations = _generations(spark, path)
    if not generations:
        return None
    return spark.read.parquet(f"{path}/base/generation={generations[-1]}").drop("bucket")


def _fetches(spark: SparkSession, path: str) -> DataFrame | None:
    if not table_exists(spark, f"{path}/fetches"):
        return None
    rows = spark.read.parquet(f"{path}/fetches")
    return rows.withColumn(FETCH, F.col(FETCH).cast("bigint"))


def _newest(rows: DataFrame, *parts: str) -> DataFrame:
    """Of each id the row of the latest fetch; of several there, the first in order. ``parts``
    are columns that follow from the id."""
    others = sorted(c for c in rows.columns if c not in ("id", FETCH, *parts))
    return newest_rows(rows, [*parts, "id"], FETCH, others)


def _all_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Base and fetches together, if the fetches are large beside the base; rows of the base
    without an id are left out, as no fetch brings them again."""
    base, fetches = _base(spark, path), _fetches(spark, path)
    if base is None or fetches is None:
        return fetches
    if fetches.count() <= FOLD_SHARE * base.count():
        return None
    return base.where("id IS NOT NULL").unionByName(fetches.select(*base.columns))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """One row per id, that of the latest fetch, with the number of that fetch.

    Rows of the base that no fetch brings again are not shuffled where the ids of the fetches
    are few enough for Spark to broadcast them. Fetches that are large beside the base are
    shuffled once, together with it.
    """
    base, fetches = _base(spark, path), _fetches(spark, path)
    if base is None and fetches is None:
        raise ValueError(f"no issues are stored at {path}")
    if base is None:
        return _newest(fetches)
    if fetches is None:
        return base
    together = _all_rows(spark, path)
    if together is not None:
        return _newest(together).unionByName(base.where("id IS NULL"))
    fetches = fetches.select(*base.columns)
    again = fetches.select("id").distinct()
    changed = base.join(again, "id", "left_semi").unionByName(fetches)
    return base.join(again, "id", "left_anti").unionByName(_newest(changed))


def fold_fetches(
    spark: SparkSession, path: str, share: float = FOLD_SHARE, buckets: int = BUCKETS
) -> bool:
    """Fold the fetches into the base, if they have more than ``share`` of its rows; tell
    whether they were. Not to be run beside another folding."""
    base, fetches = _base(spark, path), _fetches(spark, path)
    generations = _generations(spark, path)
    if fetches is not None and (
        base is None or fetches.count() > share * base.count()
    ):
        held = [n for n in folders(spark, f"{path}/fetches") if n.startswith(f"{FETCH}=")]
        new = generations[-1] + 1 if generations else 0
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        together = _all_rows(spark, path)
        if together is None:
            rows = read_issues(spark, path).withColumn("bucket", bucket).repartition("bucket")
        else:
            # one shuffle by parts of buckets finds the newest rows and writes the buckets
            parts = -(-together.count() // (PIECE_ROWS * buckets))
            part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts or 1))
            rows = together.withColumns({"bucket": bucket, "_part": part})
            rows = _newest(rows.repartition("bucket", "_part"), "bucket", "_part").drop("_part")
            if base is not None:
                rest = base.where("id IS NULL").withColumn("bucket", bucket)
                rows = rows.unionByName(rest.repartition("bucket"))
        (
            rows.sortWithinPartitions("bucket", "id")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{path}/base/generation={new}")
        )
        for name in held:
            delete_folder(spark, f"{path}/fetches/{name}")
        folded = True
    else:
        folded = False
    for old in _generations(spark, path)[:-1]:
        delete_folder(spark, f"{path}/base/generation={old}")
    return folded
