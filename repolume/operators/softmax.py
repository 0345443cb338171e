"""Multinomial logistic regression: L-BFGS on the driver, each gradient one Spark job.

Rows are packed once to blocks of flat arrays, which are kept; a pass sends the coefficients to
the tasks and adds up one loss and one gradient of each. The features are not scaled by their
spread, as Spark ML's own solver does it even without ``standardization``: words of a few texts
then pull as hard as frequent ones.

A step of L-BFGS begins with the inverse of the loss's second derivatives, of each coefficient on
its own, within the steps that leave the sum over the classes as it is (zero at the least loss).
Without them the number of passes grows with the rows: the penalty is that of one row, so the more
rows, the further frequent and rare words are apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.workers import ship

TOLERANCE = 1e-7  # of the loss: the gain of the last passes at which the solver stops
LAST = 10  # passes that the gain is taken over
STEPS, STEP_BYTES = 60, 1 << 29  # steps that L-BFGS remembers, and their bytes
AT_ONCE = 1_000_000  # products of features and classes that a task makes at once
SECOND = (0, 4, 12)  # steps before which the second derivatives are taken, in a pass each
PART_ROWS = 1_000  # a task has as many rows at least, so that small tables make few tasks
MERGED = 64  # partial sums that the driver adds up itself


def pack(rows: DataFrame) -> DataFrame:
    """labels, lengths, places, values (binary), a row for each batch of rows, from the columns
    ``label_index`` and ``features``, a sparse vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = batch.column(1), batch.column(2)
            parts = [
                np.asarray(batch.column(0)).astype(np.int32),
                np.diff(np.asarray(places.offsets)).astype(np.int32),
                np.asarray(places.flatten()).astype(np.int32),
                np.asarray(values.flatten()).astype(np.float64),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.tobytes()], pa.binary()) for part in parts],
                names=["labels", "lengths", "places", "values"],
            )

    ship(rows.sparkSession)
    vector = F.unwrap_udt("features")
    flat = rows.select("label_index", vector["indices"].alias("places"), vector["values"].alias("values"))
    return flat.mapInArrow(run, "labels binary, lengths binary, places binary, values binary")


def cut(length: np.ndarray, classes: int) -> Iterator[tuple[slice, slice]]:
    """Slices of features and of rows, for as many rows as may be computed at once."""
    ends, a = np.cumsum(length, dtype=np.int64), 0
    while a < len(length):
        start = ends[a] - length[a]
        b = np.searchsorted(ends, start + AT_ONCE // classes, "right")
        b = min(max(b, a + 1), a + AT_ONCE // classes + 1, len(length))
        yield slice(start, ends[b - 1]), slice(a, b)
        a = b


def shares(
    length: np.ndarray, place: np.ndarray, value: np.ndarray, weights: np.ndarray, bias: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows, the margin of each class, and the exponents' shares of their sum."""
    margin = np.zeros((len(length), len(bias)))
    some = np.flatnonzero(length)
    if len(some):
        begin = (np.cumsum(length) - length)[some]
        for k in range(len(bias)):
            margin[some, k] = np.add.reduceat(value * weights[k].take(place), begin)
    margin += bias
    share = np.exp(margin - margin.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return margin, share


def _add_rows(
    label: np.ndarray, length: np.ndarray, place: np.ndarray, value: np.ndarray,
    weights: np.ndarray, bias: np.ndarray, gradient: np.ndarray,
) -> float:
    """The loss of some rows; their gradient is added to ``gradient``, biases last."""
    margin, share = shares(length, place, value, weights, bias)
    rows, features = np.arange(len(label)), weights.shape[1]
    top = margin.max(axis=1)
    loss = float((np.log(np.exp(margin - top[:, None]).sum(axis=1)) + top - margin[rows, label]).sum())
    share[rows, label] -= 1
    for k in range(len(bias)):
        gradient[k, :features] += np.bincount(place, value * np.repeat(share[:, k], length), features)
    gradient[:, features] += share.sum(axis=0)
    return loss


def _add_second(
    label: np.ndarray, length: np.ndarray, place: np.ndarray, value: np.ndarray,
    weights: np.ndarray, bias: np.ndarray, second: np.ndarray,
) -> float:
    """The loss's second derivative by each coefficient is added to ``second``."""
    _, share = shares(length, place, value, weights, bias)
    share *= 1 - share
    square, features = value * value, weights.shape[1]
    for k in range(len(bias)):
        second[k, :features] += np.bincount(place, square * np.repeat(share[:, k], length), features)
    second[:, features] += share.sum(axis=0)
    return 0.0


def _floats(labels: bytes, lengths: bytes, places: bytes, values: bytes) -> tuple[np.ndarray, ...]:
    """The arrays of a row of ``pack``."""
    label, length, place = (np.frombuffer(b, np.int32) for b in (labels, lengths, places))
    return label, length, place.astype(np.intp), np.frombuffer(values, np.float64)


def _pass(
    blocks: DataFrame, groups: int, read: Callable = _floats
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The function from coefficients (classes x features, biases last) to the sums of losses
    and gradients over all rows."""
    return _added(_add_rows, blocks, groups, read)


def _added(
    add: Callable, blocks: DataFrame, groups: int, read: Callable = _floats
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The function from coefficients to the sums of what ``add`` returns and adds up."""

    def sums(coefficients: np.ndarray) -> tuple[float, np.ndarray]:
        shape, classes = coefficients.shape, len(coefficients)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = np.ascontiguousarray(coefficients[:, :-1])
            bias, total, loss, seen = coefficients[:, -1], np.zeros(shape), 0.0, 0
            for batch in batches:
                for at in range(batch.num_rows):
                    label, length, place, value = read(*(c[at].as_py() for c in batch.columns))
                    seen += len(label)
                    for of, some in cut(length, classes):
                        loss += add(label[some], length[some], place[of], value[of], weights, bias, total)
            if seen:
                found = np.append(total.ravel(), loss)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seen % groups], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                    names=["part", "sums"],
                )

        def merge(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_py(), np.float64) for b in table.column("sums"))
            return pa.table({"part": table.column("part")[:1], "sums": [total.tobytes()]})

        parts = blocks.mapInArrow(run, "part int, sums binary")
        if groups > 1:
            parts = parts.groupBy("part").applyInArrow(merge, "part int, sums binary")
        found = [np.frombuffer(r["sums"], np.float64) for r in parts.collect()]
        total = np.sum(found, axis=0)
        return float(total[-1]), total[:-1].reshape(shape)

    return sums


def minimize(
    loss_of: Callable[[np.ndarray], tuple[float, np.ndarray]],
    x: np.ndarray,
    most: int,
    second_of: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """L-BFGS from ``x``: the place of the least value of a convex function that returns value
    and gradient, in ``most`` steps at most. With ``second_of``, its second derivatives (none
    zero), gradients and ``x`` must sum to zero over the first axis, and so do the steps."""
    value, slope = loss_of(x)
    history, steps, inverse = [value], [], None
    remembered = max(5, min(STEPS, STEP_BYTES // (16 * x.size)))

    def scaled(way: np.ndarray) -> np.ndarray:
        if inverse is None:
            return way
        way = way * inverse
        return way - inverse * (way.sum(axis=0) / inverse.sum(axis=0))

    for turns in range(most):
        if second_of is not None and turns in SECOND:
            inverse = 1 / second_of(x)
        way, factors = -slope, []
        for step, turn, scale in reversed(steps):
            factors.append(scale * np.vdot(step, way))
            way = way - factors[-1] * turn
        way = scaled(way)
        if steps:
            step, turn, _ = steps[-1]
            way = way * (np.vdot(step, turn) / np.vdot(turn, scaled(turn)))
        else:
            way = way / max(abs(way).max(), 1e-300 if inverse is None else 1)
        for (step, turn, scale), factor in zip(steps, reversed(factors)):
            way = way + (factor - scale * np.vdot(turn, way)) * step
        fall = np.vdot(slope, way)
        if not fall < 0:
            break
        length = 1.0
        while True:
            next_value, next_slope = loss_of(x + length * way)
            if next_value <= value + 1e-4 * length * fall or length < 1e-6:
                break
            length *= 0.4
        if not next_value < value:
            break
        step, turn = length * way, next_slope - slope
        if np.vdot(step, turn) > 0:
            steps = [*steps, (step, turn, 1 / np.vdot(step, turn))][-remembered:]
        x, value, slope = x + step, next_value, next_slope
        history.append(value)
        if len(history) > LAST and np.mean(history[-LAST - 1 : -1]) - value <= TOLERANCE * value:
            break
    return x


def task_count(spark: SparkSession, rows: int) -> int:
    """The tasks of a pass over so many rows."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism, rows // PART_ROWS))


def fit(rows: DataFrame, counts: list[int], features: int, max_iterations: int) -> LogisticRegressionModel:
    """The model of least loss over ``label_index`` and ``features``, all rows, with the penalty
    of an unscaled L2 term over their number. ``counts`` has the rows of each label."""
    blocks = pack(rows.coalesce(task_count(rows.sparkSession, sum(counts))))
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_blocks(blocks, counts, features, max_iterations)
    finally:
        blocks.unpersist()


def fit_blocks(
    blocks: DataFrame, counts: list[int], features: int, max_iterations: int, *read: Callable
) -> LogisticRegressionModel:
    """``fit`` over packed rows, which the caller keeps; ``read`` makes arrays of one of them, if
    they are not those of ``pack``."""
    spark, n, classes = blocks.sparkSession, sum(counts), len(counts)
    partitions = task_count(spark, n)
    groups = 1 if partitions <= MERGED else int(partitions**0.5)
    sums, seconds = _pass(blocks, groups, *read), _added(_add_second, blocks, groups, *read)
    penalty = np.ones((classes, features + 1))
    penalty[:, -1] = 0

    def loss_of(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = sums(x)
        penalized = penalty * x
        return (loss + 0.5 * np.vdot(penalized, penalized)) / n, (gradient + penalized) / n

    def second_of(x: np.ndarray) -> np.ndarray:
        return (seconds(x)[1] + np.where(penalty, 1, 1e-3 * n / classes)) / n

    start = np.zeros((classes, features + 1))
    start[:, -1] = np.log1p(counts) - np.log1p(counts).mean()
    found = minimize(loss_of, start, max_iterations, second_of)
    # biases are free up to a common term
    return _model(spark, found[:, :-1], found[:, -1] - found[:, -1].mean())


def _model(spark: SparkSession, weights: np.ndarray, bias: np.ndarray) -> LogisticRegressionModel:
    context, classes = spark.sparkContext, len(bias)
    matrix = DenseMatrix(*weights.shape, weights.T.ravel())
    uid = f"LogisticRegression_{uuid4().hex[:12]}"
    name = "org.apache.spark.ml.classification.LogisticRegressionModel"
    made = LogisticRegressionModel._new_java_obj(
        name, uid, _py2java(context, matrix), _py2java(context, Vectors.dense(bias)), classes, True
    )
    return LogisticRegressionModel(made)
