import numpy as np
import pytest
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from repolume.operators import classifier, softmax, words

ODD = "ΟΔΥΣΣΕΥΣ Σ. İstanbul ǅ ß STRASSE naïve été नमस्ते 漢字かな 𝒜𝒷 x_y __ a1 ½½ ²² a‍b the The"


def texts(spark, n=240):
    labels = ["bug", "docs", "idea"]
    frequent = "crash error manual typo feature wish common word again".split()
    rows = [
        (i, f"{frequent[i % 3]} {frequent[3 + i % 3]} {frequent[i % 9]} the rare{i % 40} {ODD if i % 7 == 0 else ''}",
         labels[i % 3] if i % 11 else "bug")
        for i in range(n)
    ]
    rows.append((n, "", "docs"))
    return spark.createDataFrame(rows, "id bigint, text string, label string")


def test_words_are_those_of_the_saved_tokenizer(spark):
    others = "".join(f" a{chr(c)}b {chr(c)}{chr(c)}" for c in (*range(0x2000), *range(0x1F000, 0x1F200)))
    data = spark.createDataFrame([(ODD,), ("Plain Text, a b cd",), ("",), (others,)], "text string")
    tokenizer = RegexTokenizer(inputCol="text", outputCol="words", pattern=words.TOKEN, gaps=False)
    split = words.splitter(words.word_ranges(spark))
    for row in tokenizer.transform(data).collect():
        assert split(row["text"]) == row["words"]


def test_blocks_end_and_leave_words_out(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_WORDS", 5)
    data, split = ["aa bb the aa", None, "bb cc dd ee", "aa", "the"], str.split
    found = list(words.counted_batches(data, lambda t: split(t), {"the": -1}, True))
    assert [list(length) for length, *_ in found] == [[2, 0, 4], [1, 0]]
    assert [found[0][3][at] for at in found[0][1]] == ["aa", "bb", "bb", "cc", "dd", "ee"]
    assert list(found[0][2]) == [2, 1, 1, 1, 1, 1] and found[1][3] == ["aa"]
    known = list(words.counted_batches(data, lambda t: split(t), {"bb": 0, "dd": 1, "the": -1}, False))
    assert [(list(n), list(place)) for n, place, *_ in known] == [([1, 0, 2], [0, 0, 1]), ([0, 0], [])]


def test_counts_are_those_of_spark_ml(spark):
    rows = texts(spark)
    stop = StopWordsRemover(inputCol="words", outputCol="terms")
    tokenizer = RegexTokenizer(inputCol="text", outputCol="words", pattern=words.TOKEN, gaps=False)
    terms = stop.transform(tokenizer.transform(rows))
    theirs = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=30).fit(terms)
    counted = theirs.transform(terms)
    idf = IDF(inputCol="counts", outputCol="weights").fit(counted)
    norm = Normalizer(inputCol="weights", outputCol="features", p=2.0)
    features = norm.transform(idf.transform(counted)).orderBy("id").collect()

    blocks = words.counted(rows, stop.getStopWords())
    totals = {r["word"]: (r["times"], r["texts"]) for r in words.totals(blocks).collect()}
    assert "the" not in totals and totals["rare0"] == (6, 6)
    found = words.packed(blocks, theirs.vocabulary, ["bug", "docs", "idea"]).collect()
    assert len(found) > 1
    read = words.unpacked(idf.idf.toArray())
    at = 0
    for block in found:
        label, length, place, value = read(*map(bytes, block))
        ends = np.cumsum(length)
        for k in range(len(label)):
            of = slice(ends[k] - length[k], ends[k])
            dense = np.zeros(30)
            dense[place[of]] = value[of]
            assert np.allclose(dense, features[at]["features"].toArray())
            assert ["bug", "docs", "idea"][label[k]] == features[at]["label"]
            at += 1
    assert at == len(features)


def test_scores_are_those_of_the_model(spark):
    rows = texts(spark)
    model = classifier.train(rows)
    theirs = model.transform(rows).select("id", "predicted_label", "probability").collect()
    want = {r["id"]: (r["predicted_label"], max(r["probability"])) for r in theirs}
    issues = rows.select("id", F.lit("").alias("title"), F.col("text").alias("body"))
    found = classifier.classify_texts(issues, model).collect()
    assert len(found) == len(want)
    for row in found:
        label, confidence = want[row["id"]]
        assert row["predicted_label"] == label and row["confidence"] == pytest.approx(confidence, abs=1e-12)
    nothing = spark.createDataFrame([(1, None, None)], "id bigint, title string, body string")
    assert classifier.classify_texts(nothing, model).count() == 1


def test_training_reads_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = texts(spark)
    classifier.train(rows.withColumn("text", read("text")))
    assert seen.value == rows.count()


def test_texts_are_not_dealt_out_by_label(spark, tmp_path):
    texts(spark).write.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the texts were shuffled already
    try:
        rows = classifier.in_valid_classes(spark.read.parquet(str(tmp_path / "rows")), 5)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_second_derivatives_spare_passes():
    # features of very different sizes
    random = np.random.default_rng(3)
    n, features, classes = 4000, 60, 3
    x = random.normal(0, 1, (n, features)) * np.geomspace(0.02, 5, features)
    y = (x @ random.normal(0, 0.2, (features, classes)) + random.gumbel(0, 1, (n, classes))).argmax(axis=1)
    x1, own = np.column_stack([x, np.ones(n)]), np.eye(classes)[y]
    penalty = np.ones((classes, features + 1))
    penalty[:, -1] = 0
    seen = []

    def shares(w):
        margin = x1 @ w.T
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def loss_of(w):
        seen.append(1)
        share = shares(w)
        return (
            (-np.log((share * own).sum(axis=1)).sum() + 0.5 * (penalty * w * w).sum()) / n,
            ((share - own).T @ x1 + penalty * w) / n,
        )

    def second_of(w):
        share = shares(w)
        return ((share * (1 - share)).T @ (x1 * x1) + np.where(penalty, 1, 1e-3 * n / classes)) / n

    start = np.zeros((classes, features + 1))
    plain = loss_of(softmax.minimize(loss_of, start, 1000))[0]
    passes = len(seen)
    seen.clear()
    found = softmax.minimize(loss_of, start, 1000, second_of)
    assert loss_of(found)[0] <= plain * (1 + 1e-6)
    assert np.allclose(found.sum(axis=0), 0, atol=1e-8)
    assert len(seen) < 0.5 * passes, (len(seen), passes)
