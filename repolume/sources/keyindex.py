"""An index of keys by partition: which partitions of a table may hold a repository or an id.

For each partition (month and load) and each indexed column the index has the least and the
greatest value and a Bloom filter, in pieces of 32,768 bits made by Spark's bitmap
aggregates; a filter has as many pieces as the partition's distinct keys need. A look-up is
made of the index alone. A partition that was written after it was indexed is one that may
hold any key, as is one that never was: its files are not those that the index names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.sources.tables import (
    LOAD,
    MERGED_LOADS,
    MONTH,
    delete_in_place,
    in_partitions,
    partitions_of,
    replace_partitions,
    table_exists,
)

COLUMNS = ("repo_name", "id")
PIECE = 32_768  # bits
BITS_PER_KEY, HASHES = 12, 6  # about one false answer in 300


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Month, load and a number for the files of each partition, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(~F.contains("path", F.lit(f"/{MERGED_LOADS}/")))
    month = F.regexp_extract("path", rf"/{MONTH}=([^/]*)/", 1).try_cast("int")
    load = F.regexp_extract("path", rf"/{LOAD}=([^/]*)/", 1).try_cast("bigint")
    name = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "length")
    return files.groupBy(month.alias(MONTH), load.alias(LOAD)).agg(
        F.xxhash64(F.sort_array(F.collect_list(name))).alias("files")
    )


def _position(value: Column, pieces: Column, number: Column) -> Column:
    bits = pieces * F.lit(PIECE)
    first, step = F.pmod(F.xxhash64(value), bits), F.pmod(F.xxhash64(value, F.lit(1)), bits)
    return F.pmod(first + number * step, bits)


def index_rows(table: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The index of the partitions of a table that has ``_keyed`` month and load, without the
    number of their files."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    of = [MONTH, LOAD, "column"]
    values = table.select(MONTH, LOAD, F.inline(F.array(*pairs))).where("value IS NOT NULL").distinct()
    sizes = values.groupBy(*of).agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.ceil(F.count("*") * F.lit(BITS_PER_KEY) / F.lit(PIECE)).alias("pieces"),
    )
    numbered = values.join(sizes.select(*of, "pieces"), of).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1)))
    )
    at = _position(F.col("value"), F.col("pieces"), F.col("k"))
    placed = numbered.select(*of, at.alias("at")).select(
        *of, F.expr(f"at div {PIECE}").alias("piece"), F.expr(f"at % {PIECE}").alias("bit")
    )
    # the bitmap aggregate sorts its rows: pieces are dealt out before, so that no task sorts
    # more than its share of pieces, in rows without the strings
    bits = placed.repartition(*of, "piece").groupBy(*of, "piece").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    return bits.join(sizes, of).select(*of, "low", "high", "pieces", "piece", "bits")


def index_table(
    spark: SparkSession, path: str, index: str, columns: tuple[str, ...] = COLUMNS
) -> int:
    """Index the partitions of the table at ``path`` that are new or changed since the index
    was last brought up to date; return how many there were."""
    files = _keyed(_files(spark, path)).select(MONTH, LOAD, "files")
    stale = files
    if table_exists(spark, index):
        done = _keyed(spark.read.parquet(index)).select(MONTH, LOAD, "files").distinct()
        stale = files.join(done, [MONTH, LOAD, "files"], "left_anti")
    rows = stale.collect()  # one for each partition
    if not rows:
        return 0
    table = spark.read.parquet(path)
    if len(rows) < files.count():
        table = in_partitions(table, [_plain(r, partitions_of(table)) for r in rows])
    stale = spark.createDataFrame(rows, files.schema)
    # a partition that a job replaces meanwhile has other files than those that are noted
    found = index_rows(_keyed(table), columns).join(stale, [MONTH, LOAD])
    replace_partitions(found, index)
    return len(rows)


def _keyed(rows: DataFrame) -> DataFrame:
    """Month and load as numbers that are never null: 0 for no month, the least number for no
    load."""
    load = F.col(LOAD) if LOAD in rows.columns else F.lit(None)
    none = F.lit(-(1 << 62))
    return rows.withColumns(
        {MONTH: F.coalesce(F.col(MONTH).cast("int"), F.lit(0)), LOAD: F.coalesce(load.cast("bigint"), none)}
    )


def _plain(row, partitions: list[str]) -> tuple:
    """The values of a partition given by ``_keyed`` month and load."""
    month = row[MONTH] or None
    return (month, row[LOAD]) if LOAD in partitions else (month,)


def may_hold(spark: SparkSession, path: str, index: str, column: str, values: list) -> DataFrame:
    """Month and load (as ``_keyed``) of the partitions that may hold one of a few values."""
    files = _keyed(_files(spark, path)).select(MONTH, LOAD, "files")
    if not values:
        return files.select(MONTH, LOAD).limit(0)
    if not table_exists(spark, index):
        return files.select(MONTH, LOAD)
    rows = _keyed(spark.read.parquet(index)).join(files, [MONTH, LOAD, "files"])
    known = rows.select(MONTH, LOAD).where(F.col("column") == column).distinct()
    asked = F.explode(F.array(*[F.lit(str(v)) for v in values]))
    rows = rows.where(F.col("column") == column).withColumn("value", asked)
    rows = rows.where(F.col("value").between(F.col("low"), F.col("high")))
    hits = F.lit(0)
    for k in range(HASHES):
        at = _position(F.col("value"), F.col("pieces"), F.lit(k))
        bit = at % F.lit(PIECE)
        byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
        is_set = F.getbit(byte.cast("int"), (bit % 8).cast("int")).cast("int")
        here = F.floor(at / F.lit(PIECE)) == F.col("piece")
        hits += F.when(here, is_set).otherwise(0)
    found = rows.groupBy(MONTH, LOAD, "value").agg(F.sum(hits).alias("hits"))
    found = found.where(F.col("hits") == HASHES).select(MONTH, LOAD).distinct()
    unknown = files.select(MONTH, LOAD).join(known, [MONTH, LOAD], "left_anti")
    return found.unionByName(unknown)


def delete_keys(spark: SparkSession, path: str, index: str, column: str, values: list) -> list[tuple]:
    """Delete the rows whose ``column`` is one of a few values; return the (month, load) that
    were looked at. Partitions that the index rules out are neither read nor listed again."""
    partitions = partitions_of(spark.read.parquet(path))
    found = may_hold(spark, path, index, column, values).collect()  # a row for each partition
    among = [_plain(r, partitions) for r in found]
    if among:
        condition = F.col(column).cast("string").isin([str(v) for v in values])
        delete_in_place(spark, path, condition, among)
    return among


def rows_of_keys(spark: SparkSession, path: str, index: str, column: str, values: list) -> DataFrame:
    """The rows whose ``column`` is one of a few values, read from the partitions that may
    hold one."""
    table = spark.read.parquet(path)
    found = may_hold(spark, path, index, column, values).collect()  # a row for each partition
    table = in_partitions(table, [_plain(r, partitions_of(table)) for r in found])
    return table.where(F.col(column).cast("string").isin([str(v) for v in values]))
