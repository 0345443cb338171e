"""The registered queries of this package: each operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.llm import language as languages
from repolume.llm import matching, negatives, packing, periods, secret_scan, toxicity
from repolume.llm import quality as qualities
from repolume.llm import rules as quality_rules
from repolume.llm.common import fold, table
from repolume.llm.decontaminate import decontaminate
from repolume.llm.jaccard import similar_documents
from repolume.llm.licences import license_blocks
from repolume.llm.oracles import ORACLES  # noqa: F401
from repolume.llm.substrings import remove_repeats


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = languages.fit_language(documents)
    return languages.language(documents, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85).select(
        "doc_id", "n_shingles", "component_id"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = qualities.fit_quality(documents, table(spark, sf_dir, "labels"))
    return qualities.quality(documents, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")

    only = secret_scan.span_text(F.filter("found", lambda s: s.kind.isin(base)))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(only.cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("found")).alias("spans"),
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(documents, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), negatives.whole_cells(F.col("embedding"), 256).alias("cells")
    )
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by a hash of the id, the words from a place on
    repeat with a period that is about a third to a tenth of what follows."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.expr("g % n")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)")
    )
    again = F.expr("transform(w, (x, i) -> if(i < a, x, w[CAST(a + (i - a) % p AS INT)]))")
    planted = F.col("w").isNotNull() & (F.col("n") > 0)
    return rows.select(
        "doc_id", F.when(planted, F.array_join(again, " ")).otherwise(F.col("text")).alias("text")
    )


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # the greatest length / period: compared by whole numbers, first by what a milli tells apart
    best = F.expr(
        """aggregate(runs, CAST(null AS struct<start:long,length:long,period:long>), (b, r) ->
             CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period
                    OR (r.length * b.period = b.length * r.period
                        AND (r.start < b.start OR (r.start = b.start AND r.period < b.period)))
                  THEN r ELSE b END)"""
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.text_scores(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


QUERIES = {
    "op1_pack": op1_pack,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_rules": op8_rules,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_periods": op12_periods,
    "op13_matching": op13_matching,
}
