"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and works on all
rows that the stage before it kept; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.llm import packing, secret_scan
from repolume.llm import quality as qualities
from repolume.llm.common import table
from repolume.llm.decontaminate import decontaminate
from repolume.llm.jaccard import similar_documents
from repolume.workspace import new_path

KEY = ["doc_id", "text_hash"]


def _joined(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one column (no name can clash), its key, and the other columns
    of ``chosen``, which has each key once; rows whose id and text are not chosen go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
    )
    chosen = chosen.withColumnsRenamed({k: f"r_{k}" for k in KEY})
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEY]
    return rows.join(chosen, on[0] & on[1]).drop(*(f"r_{k}" for k in KEY))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects, at its own cutoff. The labelled vectors are
    fitted on the documents of this stage."""
    model = qualities.fit_quality(docs, table(spark, sf_dir, "labels"))
    return qualities.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five words, similarity 0.8): the
    one with the smallest id, null ids last; of repeated rows, one. Texts without words are
    no copies of each other, and all stay."""
    found = similar_documents(docs, words=5, percent=80)
    first = F.struct(F.col("doc_id").isNull().alias("last"), *KEY)
    one = found.where("n_shingles > 0").groupBy("component").agg(F.min(first).alias("k"))
    one = one.select("k.doc_id", "k.text_hash", F.lit(True).alias("has_words")).distinct()
    none = found.where("n_shingles = 0").select(*KEY, F.lit(False).alias("has_words")).distinct()
    kept = _joined(docs, one.unionByName(none))
    once = kept.where("has_words").dropDuplicates(KEY)
    return once.unionByName(kept.where("NOT has_words")).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _joined(docs, found.where("n_hit = 0").select(*KEY).distinct()).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their tokens, by sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# A fitted model, similarity components and a tokenizer are beyond SQL; tests/llm compares
# each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
