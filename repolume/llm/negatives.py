"""Hard negatives of anchors, by exact inner products of integer vectors.

Rows are dealt by a hash of their id into tiles of bounded size: matrices of whole numbers
with their ids and labels. Each pair of an anchor tile and a candidate tile is one row of a
join on both tile numbers, so the work spreads over all tasks however few anchors there are.
A pair's inner products come from Strassen's recursion: seven products of halves in place of
eight, odd sides padded with zeros, additions exact.

There are two passes over the pairs. The first keeps, for each anchor and tile, the best rows
of the anchor's own label; these heaps merge into the anchor's positives. Each positive opens
a window of scores, and the second pass keeps, for each window and tile, the best rows of
other labels within it; these heaps merge into the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.llm.common import map_arrow, ship, written

ANCHOR_TILE, CANDIDATE_TILE = 512, 4096  # rows, about
LEAF = 32  # sides that are multiplied directly
MOST_TASKS = 20_000
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score

TILE = "tile long, ids binary, labels binary, width long, cells binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product of whole numbers, by Strassen's recursion down to sides of ``leaf``."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    h, j, w = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :j], a[:h, j:], a[h:, :j], a[h:, j:]
    b11, b12, b21, b22 = b[:j, :w], b[:j, w:], b[j:, :w], b[j:, w:]
    out = np.zeros((m, n), a.dtype)
    c11, c12, c21, c22 = out[:h, :w], out[:h, w:], out[h:, :w], out[h:, w:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11, leaf)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of int64; one that 64 bits can't hold raises
    an OverflowError."""
    width = max(a.shape[1], b.shape[1])
    a = np.pad(a, ((0, 0), (0, width - a.shape[1])))
    b = np.pad(b, ((0, 0), (0, width - b.shape[1])))
    most = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
    # the recursion's sums are right modulo 2 ** 64, whatever they pass through
    if most[0] * most[1] * width < 1 << 63:
        return strassen(a, b.T)
    return strassen(a.astype(object), b.T.astype(object)).astype(np.int64)


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by place."""
    if len(scores) > most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        above = np.flatnonzero(scores > edge)
        level = np.flatnonzero(scores == edge)[: most - len(above)]
        places = np.concatenate([above, level])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


def clean_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, cells (array of long): the rows that take part, one of each id.

    ``cells`` of the given rows are whole numbers already; a row with a null id, label, vector
    or component takes no part. Of rows with the same id the smallest (label, cells) counts.
    """
    whole = F.col("cells").isNotNull() & ~F.exists("cells", lambda x: x.isNull())
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), "cells")).alias("row")
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(one)
    return rows.select("vec_id", "row.label", "row.cells")


def whole_cells(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    odd = F.exists(
        vector,
        lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)),
    )
    return F.when(
        ~odd, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    )


def _least_kind(cells: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if not cells.size or (cells.min() >= limits.min and cells.max() <= limits.max):
            return cells.astype(kind)
    return cells


def tiles_of(rows: DataFrame, tiles: int) -> DataFrame:
    """One row per tile: ids in rising order, labels, and the matrix, as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        cells = table.column("cells").combine_chunks().to_pylist()
        width = max(map(len, cells))
        matrix = np.zeros((len(ids), width), np.int64)
        for to, i in enumerate(order.tolist()):
            matrix[to, : len(cells[i])] = cells[i]
        matrix = _least_kind(matrix)
        return pa.table(
            {
                "tile": pa.array([table.column("tile")[0].as_py()], pa.int64()),
                "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                "labels": pa.array(
                    [table.column("label").to_numpy()[order].astype("<i8").tobytes()], pa.binary()
                ),
                "width": pa.array([width], pa.int64()),
                "cells": pa.array([matrix.dtype.char.encode() + matrix.tobytes()], pa.binary()),
            }
        )

    ship(rows.sparkSession)
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)))
    return dealt.groupBy("tile").applyInArrow(pack, TILE)


def _tile(ids: bytes, labels: bytes, width: int, cells: bytes) -> tuple:
    ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
    matrix = np.frombuffer(cells, cells[:1].decode(), offset=1).astype(np.int64)
    return ids, labels, matrix.reshape(len(ids), width)


class Pairs:
    """All pairs of an anchor tile and a candidate tile."""

    def __init__(self, rows: DataFrame, anchor: Column):
        spark = rows.sparkSession
        rows = written(spark, rows, "vectors")
        counts = rows.agg(F.count("*").alias("all"), F.count_if(anchor).alias("anchors")).first()
        self.anchor_tiles = max(1, -(-counts["anchors"] // ANCHOR_TILE))
        self.candidate_tiles = max(1, -(-counts["all"] // CANDIDATE_TILE))
        anchors = tiles_of(rows.where(anchor), self.anchor_tiles)
        self.anchors = written(spark, anchors, "anchor-tiles")
        self.candidates = written(spark, tiles_of(rows, self.candidate_tiles), "candidate-tiles")

    def joined(self, anchors: DataFrame) -> DataFrame:
        """The columns of the anchor tile, then the four of the candidate tile."""
        tasks = min(MOST_TASKS, self.anchor_tiles * self.candidate_tiles)
        key = ["tile", "other"]

        def numbers(count: int) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

        left = anchors.withColumn("other", numbers(self.candidate_tiles))
        right = self.candidates.select(
            F.col("tile").alias("other"),
            numbers(self.anchor_tiles).alias("tile"),
            *(F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "width", "cells")),
        )
        left, right = (side.repartition(tasks, *key) for side in (left, right))
        return left.join(right, key).drop(*key)


def _first(rows: DataFrame, key: list[str], name: str, most: int) -> DataFrame:
    """The ``most`` rows of each key by falling score, ties by ``name``, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _long(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def positives_of(pairs: Pairs, most: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's best other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                ids, labels, matrix = _tile(*row[:4])
                other_ids, other_labels, other = _tile(*row[4:])
                scores = products(matrix, other)
                out: list = [[], [], []]
                for i, own in enumerate(ids.tolist()):
                    same = np.flatnonzero((other_labels == labels[i]) & (other_ids != own))
                    score = scores[i, same]
                    places = best(score, most)
                    out[0] += [own] * len(places)
                    out[1] += other_ids[same[places]].tolist()
                    out[2] += score[places].tolist()
                yield pa.RecordBatch.from_arrays(
                    [_long(values) for values in out], names=["anchor_id", "positive_id", "score"]
                )

    heaps = map_arrow(
        pairs.joined(pairs.anchors), run, "anchor_id long, positive_id long, score long"
    )
    return _first(heaps, ["anchor_id"], "positive_id", most).select(
        "anchor_id", "positive_id", F.col("score").alias("positive_score")
    )


def negatives_of(pairs: Pairs, positives: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, score, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                ids, labels, matrix = _tile(*row[:4])
                other_ids, other_labels, other = _tile(*row[5:])
                scores = products(matrix, other)
                place = {own: i for i, own in enumerate(ids.tolist())}
                out: list = [[], [], [], [], []]
                differs: dict = {}
                for window in row[4]:
                    own, positive = window["anchor_id"], window["positive_score"]
                    i = place[own]
                    if i not in differs:
                        kept = np.flatnonzero(other_labels != labels[i])
                        differs[i] = kept, scores[i, kept]
                    kept, score = differs[i]
                    # low * positive <= 100 * score <= high * positive, in whole numbers
                    least, greatest = -(-low * positive // 100), high * positive // 100
                    inside = np.flatnonzero((score >= least) & (score <= greatest))
                    places = kept[inside[best(score[inside], most)]]
                    out[0] += [own] * len(places)
                    out[1] += [window["positive_id"]] * len(places)
                    out[2] += [positive] * len(places)
                    out[3] += other_ids[places].tolist()
                    out[4] += scores[i, places].tolist()
                yield pa.RecordBatch.from_arrays(
                    [_long(values) for values in out], names=names
                )

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "score"]
    # a tile has a bounded number of anchors, and each of them ``positives`` windows at most
    windows = positives.groupBy(
        F.pmod(F.xxhash64("anchor_id"), F.lit(pairs.anchor_tiles)).alias("tile")
    ).agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("windows"))
    anchors = pairs.anchors.join(windows, "tile")
    heaps = map_arrow(pairs.joined(anchors), run, ", ".join(f"{name} long" for name in names))
    return _first(heaps, ["anchor_id", "positive_id"], "negative_id", most)


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOWEST,
    high: int = HIGHEST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, label and cells (array of long); ``anchor`` is a condition on
    vec_id. A row's score is its inner product with the anchor; higher scores come first, ties
    by smaller vec_id. For each anchor and each of its first ``positives`` other rows of the
    same label, the first ``negatives`` rows of other labels whose score is ``low`` to ``high``
    percent of the positive's, by rank from 1. An anchor without positives, and a positive
    without negatives, has no rows.

    Rows with a null id, label, vector or component take no part; of rows with the same id the
    smallest (label, cells) counts. A shorter vector counts as filled up with zeros, an empty
    one as all zeros. Scores that 64 bits can't hold raise an error. An empty table gives no
    rows; other columns may have any name.
    """
    pairs = Pairs(clean_rows(embeddings), anchor)
    found = positives_of(pairs, positives)
    found = written(embeddings.sparkSession, found, "positives")
    return negatives_of(pairs, found, negatives, low, high).select(
        "anchor_id",
        "positive_id",
        "rank",
        "negative_id",
        "positive_score",
        F.col("score").alias("negative_score"),
    )
