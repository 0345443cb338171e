import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from repolume.operators import softmax


def loss(rows, weights, bias):
    margins = np.array([weights @ v.toArray() + bias for v, _ in rows])
    top = margins.max(axis=1)
    total = np.log(np.exp(margins - top[:, None]).sum(axis=1)) + top
    own = margins[np.arange(len(rows)), [int(k) for _, k in rows]]
    return (total - own).mean() + 0.5 / len(rows) * (weights**2).sum()


def test_few_passes_reach_the_least_loss(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = []
    for i in range(400):
        # frequent words and rare ones; a row without any
        words = sorted({*(int(w) for w in random.zipf(1.4, 12) if w < 300), 300 + i % 40}) if i else []
        value = 1 / max(len(words), 1) ** 0.5
        rows.append((Vectors.sparse(340, words, [value] * len(words)), float((sum(words) + i) % 3)))
    data = spark.createDataFrame(rows, ["features", "label_index"])
    seen, make = [], softmax._pass

    def counted(blocks, groups):
        found = make(blocks, groups)
        return lambda x: seen.append(1) or found(x)

    monkeypatch.setattr(softmax, "_pass", counted)
    monkeypatch.setattr(softmax, "AT_ONCE", 100)
    counts = [sum(k == c for _, k in rows) for c in range(3)]
    model = softmax.fit(data, counts, 340, 1000)
    found = loss(rows, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    theirs = LogisticRegression(
        labelCol="label_index", family="multinomial", maxIter=1000, standardization=False,
        regParam=1 / len(rows),
    ).fit(data)
    before = loss(rows, theirs.coefficientMatrix.toArray(), theirs.interceptVector.toArray())
    assert found <= before + 1e-6
    assert len(seen) < theirs.summary.totalIterations
    labels = [r["prediction"] for r in model.transform(data).collect()]
    assert np.mean(np.array(labels) == [r["prediction"] for r in theirs.transform(data).collect()]) > 0.99


def test_partial_sums_of_groups_are_those_of_all(spark):
    rows = [(Vectors.sparse(5, [i % 5], [1.0 + i]), float(i % 2)) for i in range(50)]
    blocks = softmax.pack(spark.createDataFrame(rows, ["features", "label_index"]).repartition(6)
                          .select("label_index", "features"))
    x = np.random.default_rng(1).normal(size=(2, 6))
    (a, g), (b, h) = (softmax._pass(blocks, groups)(x) for groups in (1, 3))
    assert np.isclose(a, b) and np.allclose(g, h)
