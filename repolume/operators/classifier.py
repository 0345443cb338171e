"""Issue labels: training rows, split, a Spark ML text classifier, scores, report."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel,
    IDFModel,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime
from repolume.operators import softmax, words

# Class size, vocabulary, iterations, split.
MIN_CLASS_ROWS = 30
VOCABULARY = 5000
MAX_ITERATIONS = 1000
TEST_SHARE = 0.2
SEED = 42


def issue_text() -> Column:
    """Title and body as one text, the same for training and scoring."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def training_rows(issues: DataFrame) -> DataFrame:
    """Labelled issues as (id, text, label); the label is the first one."""
    return issues.where(F.size("labels") > 0).select(
        "id", issue_text().alias("text"), F.try_element_at("labels", F.lit(1)).alias("label")
    ).where("label IS NOT NULL")


def valid_classes(rows: DataFrame, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """Classes with enough rows, largest first."""
    return (
        rows.groupBy("label")
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= min_rows)
        .orderBy(F.desc("count"), "label")
    )


def in_valid_classes(rows: DataFrame, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """The rows of classes with enough rows.

    The classes are counted from the labels alone, and broadcast: they are fewer than rows by
    ``min_rows`` and hold no text, whereas texts dealt out by label would make as many tasks as
    there are classes, the largest with most of the rows. (By its own measure Spark decides when
    the texts are shuffled already.)
    """
    classes = (
        rows.groupBy("label")
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= min_rows)
        .select("label")
    )
    return rows.join(F.broadcast(classes), "label", "left_semi")


def with_split(rows: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Mark each row train or test by a hash of its id, the same on every run
    and under any partitioning."""
    edge = format(int(test_share * 256), "02x")
    first_byte = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 2)
    return rows.withColumn("split", F.when(first_byte < edge, "test").otherwise("train"))


def train(rows: DataFrame, max_iterations: int = MAX_ITERATIONS) -> PipelineModel:
    """TF-IDF over the most frequent words and a multinomial logistic regression.

    The texts are read once, and kept as counts of their words; words that come equally often
    enter the vocabulary in alphabetical order. The penalty is that of an unscaled L2 term over n
    rows. The coefficients, classes x ``VOCABULARY`` doubles, are held by the driver: with tens of
    thousands of classes raise ``min_rows`` of ``in_valid_classes``.
    """
    spark = rows.sparkSession
    tokenizer = RegexTokenizer(inputCol="text", outputCol="words", pattern=words.TOKEN, gaps=False)
    stop_words = StopWordsRemover(inputCol="words", outputCol="terms")
    counted = words.counted(rows, [w.lower() for w in stop_words.getStopWords()])
    counted.persist(StorageLevel.MEMORY_AND_DISK)
    packed = None
    try:
        each = counted.select(F.explode("labels").alias("label")).groupBy("label")
        rows_of = {r["label"]: r["count"] for r in each.count().collect()}
        labels = sorted(rows_of, key=lambda label: (-rows_of[label], label))
        n = sum(rows_of.values())
        top = words.totals(counted).orderBy(F.desc("times"), "word").limit(VOCABULARY).collect()
        if not top:
            raise ValueError("the training rows have no words")
        vocabulary, texts = [r["word"] for r in top], [r["texts"] for r in top]
        weights = np.log((n + 1) / (np.array(texts) + 1))
        packed = words.packed(counted.coalesce(softmax.task_count(spark, n)), vocabulary, labels)
        packed.persist(StorageLevel.MEMORY_AND_DISK).foreachPartition(lambda _: None)
        counted.unpersist()
        regression = softmax.fit_blocks(
            packed, [rows_of[label] for label in labels], len(vocabulary), max_iterations,
            words.unpacked(weights),
        )
    finally:
        counted.unpersist()
        if packed is not None:
            packed.unpersist()
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="counts")
    idf = _idf_model(spark, weights, texts, n).setInputCol("counts").setOutputCol("weights")
    norm = Normalizer(inputCol="weights", outputCol="features", p=2.0)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)
    return PipelineModel([tokenizer, stop_words, vectors, idf, norm, regression, names])


def _idf_model(spark: SparkSession, weights: np.ndarray, texts: list[int], n: int) -> IDFModel:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    counts = context._gateway.new_array(jvm.long, len(texts))
    for at, count in enumerate(texts):
        counts[at] = count
    values = _py2java(context, Vectors.dense(weights)).toArray()
    vector = jvm.org.apache.spark.mllib.linalg.Vectors.dense(values)
    made = jvm.org.apache.spark.mllib.feature.IDFModel(vector, counts, n)
    name = "org.apache.spark.ml.feature.IDFModel"
    return IDFModel(IDFModel._new_java_obj(name, f"IDF_{uuid4().hex[:12]}", made))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _scores(model: PipelineModel, spark: SparkSession) -> Callable[[Column], Column]:
    """The function from texts to (label, confidence), with the parameters of a model of ``train``:
    what its stages give, without a column of words and vectors for each stage."""
    _, stop_words, vectors, idf, _, regression, names = model.stages
    return words.scorer(
        spark,
        [w.lower() for w in stop_words.getStopWords()],
        vectors.vocabulary,
        idf.idf.toArray(),
        regression.coefficientMatrix.toArray(),
        regression.interceptVector.toArray(),
        names.getLabels(),
    )


def classify_texts(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """The given rows (``title``, ``body`` and others) with the predicted label
    and its probability."""
    columns = [c for c in texts.columns if c != "text"]
    score = _scores(model, texts.sparkSession)(issue_text())
    return texts.select(
        *columns, score["label"].alias("predicted_label"), score["confidence"].alias("confidence")
    )


def unscored_issues(issues: DataFrame, predictions: DataFrame) -> DataFrame:
    """Issues without a prediction; a prediction without an issue id excludes none.

    Predictions are made distinct first, within each task and then by the same
    shuffle the join uses, so an issue predicted very often weighs nothing.
    """
    done = predictions.select(F.col("issue_id").alias("id")).distinct()
    return issues.join(done, "id", "left_anti")


def score_issues(
    issues: DataFrame, predictions: DataFrame, model: PipelineModel, prediction_date: AsOf
) -> DataFrame:
    """Prediction rows for the issues that have none yet."""
    todo = unscored_issues(issues, predictions).select("id", "title", "body")
    return classify_texts(todo, model).select(
        F.col("id").alias("issue_id"),
        "predicted_label",
        "confidence",
        F.lit(as_datetime(prediction_date).date()).alias("prediction_date"),
    )


def predict_split(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """(label, prediction) of rows that already have a ``text``."""
    score = _scores(model, rows.sparkSession)(F.col("text"))
    return rows.select("label", score["label"].alias("prediction"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, and the accuracy, macro
    and weighted averages, from rows of (label, prediction)."""
    confusion = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("hits")),
    )
    totals = confusion.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    hits, support = F.col("hits"), F.col("support")
    per_class = totals.select(
        "class",
        ratio(hits, F.col("predicted")).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, F.col("predicted") + support).alias("f1_score"),
        "support",
        "hits",
    )
    rated = ["precision", "recall", "f1_score"]

    def row(name: str, values: list[Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(c) for c, v in zip(rated, values)],
            F.col("total").alias("support"),
        )

    sums = per_class.agg(
        F.sum("support").alias("total"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in rated],
        *[(F.sum(F.col(c) * support) / F.sum("support")).alias(f"weighted_{c}") for c in rated],
    )
    nothing = F.lit(None).cast("double")
    overall = sums.select(
        F.inline(
            F.array(
                row("accuracy", [nothing, nothing, F.col("accuracy")]),
                row("macro avg", [F.col(f"macro_{c}") for c in rated]),
                row("weighted avg", [F.col(f"weighted_{c}") for c in rated]),
            )
        )
    )
    return per_class.drop("hits").unionByName(overall)
