"""Hard negatives: Strassen's products, and the whole search against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolume.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (65, 70, 33), (128, 64, 257), (40, 0, 40)])
@pytest.mark.parametrize("leaf", [1, 8, 32])
def test_strassen(shape, leaf):
    m, k, n = shape
    if leaf == 1 and m * n > 5000:
        pytest.skip("slow")
    rng = np.random.default_rng(m + k + n)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_products_near_the_limit_of_64_bits():
    a = np.full((40, 40), 1 << 30)
    b = np.full((40, 40), -(1 << 27))
    assert (negatives.products(a, b) == -40 * (1 << 57)).all()
    assert (negatives.products(a[:, :8], b) == -8 * (1 << 57)).all()  # zeros fill up
    with pytest.raises(OverflowError):
        negatives.products(a << 10, a << 10)


def test_best_breaks_ties_by_place():
    assert negatives.best(np.array([1, 5, 5, 2, 5]), 2).tolist() == [1, 2]
    assert negatives.best(np.array([1, 2]), 5).tolist() == [1, 0]
    assert negatives.best(np.zeros(0, np.int64), 3).tolist() == []


def by_hand(rows, positives=5, count=10, low=30, high=90):
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        cells = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept[vec_id] = min(kept.get(vec_id, (label, cells)), (label, cells))
    out = []
    for anchor, (label, cells) in kept.items():
        if anchor % 100:
            continue
        score = {
            i: sum(x * y for x, y in zip(cells, c)) for i, (_, c) in kept.items() if i != anchor
        }
        order = sorted(score, key=lambda i: (-score[i], i))
        own = [i for i in order if kept[i][0] == label][:positives]
        others = [i for i in order if kept[i][0] != label]
        for p in own:
            found = [
                i for i in others if low * score[p] <= 100 * score[i] <= high * score[p]
            ][:count]
            out += [(anchor, p, k + 1, i, score[p], score[i]) for k, i in enumerate(found)]
    return sorted(out)


def found(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.select("vec_id", "label", negatives.whole_cells(F.col("embedding"), 256).alias("cells"))
    out = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **limits)
    assert out.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return sorted(tuple(r) for r in out.collect())


def vectors(seed, count, width=8, labels=3):
    rng = random.Random(seed)
    return [
        (i, rng.randrange(labels), [round(rng.uniform(-1, 1), 1) for _ in range(width)])
        for i in range(count)
    ]


def test_search_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 2)
    monkeypatch.setattr(negatives, "CANDIDATE_TILE", 70)
    rows = vectors(1, 420)
    result = found(spark, rows)
    assert result == by_hand(rows)
    assert len(result) > 100


def test_hot_vector_and_label(spark, monkeypatch):
    """A third of the rows are one vector of one label, so that ties decide."""
    monkeypatch.setattr(negatives, "CANDIDATE_TILE", 50)
    rows = vectors(2, 300) + [(1000 + i, 1, [0.5] * 8) for i in range(150)]
    rows += [(2000 + i, 2, [0.25] * 8) for i in range(60)]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows, positives=2, negatives=3, low=10, high=100) == by_hand(
        rows, 2, 3, 10, 100
    )


def test_odd_rows(spark):
    rows = vectors(3, 210)
    rows += [
        (None, 1, [0.5] * 8),
        (300, None, [0.5] * 8),
        (400, 1, None),
        (500, 1, [0.5, None]),
        (600, 1, [0.5, math.nan]),
        (700, 1, [0.5, math.inf]),
        (800, 1, []),
        (900, 1, [0.9] * 3),
        (100, 0, [0.1] * 8),  # an id twice
        (7, *rows[7][1:]),  # a repeated row
        (-100, 2, [0.7] * 8),
    ]
    assert found(spark, rows) == by_hand(rows)


def test_empty_tables_and_other_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    rows = spark.createDataFrame(
        [(i, i % 2, [1, i], "x", "y", "z") for i in range(101)],
        "vec_id long, label int, cells array<long>, tile string, score string, ids string",
    )
    out = negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()
    assert {r.anchor_id for r in out} <= {0, 100} and out
