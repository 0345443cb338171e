"""Issues and predictions stored by buckets of the issue id.

Both tables have the same number of buckets of the same key, so finding the issues without a
prediction joins bucket with bucket: the texts are never shuffled, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.operators.classifier import unscored_issues

BUCKETS = 256  # some 100 to 400 MB of issues each


def _write(rows: DataFrame, table: str, path: str, key: str, buckets: int, mode: str) -> None:
    # one file for each bucket: rows are dealt out by the hash that names the bucket
    (
        rows.repartition(buckets, key)
        .write.mode(mode)
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )


def store_scorable(issues: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """The issues as a table of the catalog with buckets of ``id``, over what it held; its files
    lie at ``path``. Rows of a null id are kept, in one bucket."""
    _write(issues, table, path, "id", buckets, "overwrite")


def bucket_count(spark: SparkSession, table: str) -> int:
    """The buckets of a stored table."""
    found = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    if found is None:
        raise ValueError(f"{table} has no buckets")
    return int(found["data_type"])


def add_predictions(
    predictions: DataFrame, table: str, path: str, buckets: int = BUCKETS
) -> None:
    """Adds the predictions of issues that have none in the table, with buckets of ``issue_id``.

    A load that is repeated, after a lost driver say, adds nothing. Only new rows are shuffled.
    Predictions without an issue are kept once more each time: they belong to no issue.
    The number of buckets is that of the table, if there is one.
    """
    spark = predictions.sparkSession
    if spark.catalog.tableExists(table):
        buckets = bucket_count(spark, table)
        done = spark.table(table).select("issue_id").distinct()
        predictions = predictions.join(done, "issue_id", "left_anti").select(*predictions.columns)
    _write(predictions, table, path, "issue_id", buckets, "append")


def unscored(spark: SparkSession, issues: str, predictions: str) -> DataFrame:
    """The stored issues without a stored prediction. Both tables must have as many buckets."""
    if bucket_count(spark, issues) != bucket_count(spark, predictions):
        raise ValueError(f"{issues} and {predictions} have different numbers of buckets")
    return unscored_issues(
        spark.table(issues), spark.table(predictions).where(F.col("issue_id").isNotNull())
    )
