"""Quality by votes of nearest labelled texts.

A text is a vector of terms that describe its form: trigrams of character classes, and
marks for repeated words and lines. Logarithmic counts, weighted by the rarity of a term,
are projected on the leading singular vectors of a bounded labelled sample (latent
semantic analysis). The labelled vectors are broadcast (their number and width are
parameters, so their size has a bound); each block of documents is multiplied with all of
them, which gives exact cosines, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import bounded_rows, fold, in_pieces, map_arrow, one_label, sample_texts, worker_state

# Labelled texts, at most: of class 0 and of class 1.
PER_CLASS = (1500, 2500)
RANK = 32
NEIGHBOURS = 25
BLOCK = 256  # documents multiplied at once
SHARPNESS = 8  # a vote weighs its similarity to this power


def _classes() -> np.ndarray:
    """Bytes to classes: a letter (also any byte of a non-ASCII character), a capital, a
    digit, other white space; each other character is its own class."""
    table = np.arange(256)
    table[128:] = table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[:10] = table[11:33] = ord(" ")
    kinds = np.unique(table)
    return np.searchsorted(kinds, table).astype(np.int64)


CLASSES = _classes()
KINDS = int(CLASSES.max()) + 1
MARKS = 4
TERMS = KINDS**3 + MARKS


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the terms of a text and their counts; nothing for a null or empty text."""
    data = (text or "").encode()
    if not data:
        return np.zeros(0, np.int64), np.zeros(0)
    kind = CLASSES[np.frombuffer(b" " + data + b" ", np.uint8)]
    codes = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
    ids, counts = np.unique(codes, return_counts=True)
    words, lines = data.split(), data.split(b"\n")
    marks = np.array(
        [
            len(words),
            sum(map(eq, words, words[1:])),
            len(words) - len(set(words)),
            len(lines) - len(set(lines)),
        ]
    )
    there = np.flatnonzero(marks)
    return (
        np.concatenate([ids, KINDS**3 + there]),
        np.concatenate([counts, marks[there]]).astype(float),
    )


class LatentVotes:
    """Projection to the latent space, and the labelled vectors in it."""

    def __init__(self, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.rank, self.neighbours = rank, neighbours
        self.used = np.zeros(0, np.int64)

    def fit(self, texts: list[str], labels: list[int]) -> LatentVotes:
        self.labels = np.asarray(labels, np.float32)
        bags = [terms(t) for t in texts]
        seen = np.zeros(TERMS)
        for ids, _ in bags:
            seen[ids] += 1
        self.used = np.flatnonzero(seen >= min(3, max(1, len(texts))))
        self.place = np.full(TERMS, -1, np.int64)
        self.place[self.used] = np.arange(len(self.used))
        self.rarity = (np.log((1 + len(texts)) / (1 + seen[self.used])) + 0.1).astype(np.float32)
        weighted = self._weighted(bags)
        # singular vectors from the terms' Gram matrix: terms x terms, however many texts
        values, vectors = np.linalg.eigh(weighted.T @ weighted)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : self.rank]).astype(np.float32)
        self.vectors = self._unit(weighted @ self.basis)
        return self

    def _weighted(self, bags: list) -> np.ndarray:
        out = np.zeros((len(bags), len(self.used)), np.float32)
        for row, (ids, counts) in enumerate(bags):
            at = self.place[ids]
            known = at >= 0
            out[row, at[known]] = np.log1p(counts[known])
        return self._unit(out * self.rarity)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 in the weighted votes; 0 for a text without terms, which is like
        none of them, and 0.5 for all others if there are no labelled texts."""
        if not len(self.used):
            return np.array([0.5 if t else 0.0 for t in texts])
        out = np.zeros(len(texts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            bags = [terms(t) for t in texts[at : at + BLOCK]]
            cosine = self._unit(self._weighted(bags) @ self.basis) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1) ** SHARPNESS
            votes = (weight * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK] = votes / np.maximum(weight.sum(axis=1), 1e-9)
        return out


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: tuple = PER_CLASS):
    """Labelled vectors of rows whose crc32(doc_id) modulo 4 is not 2, at most
    ``per_class`` of labels 0 and 1."""
    allowed = one_label(labels, "quality").where(fold("doc_id", 4) != 2)
    chosen = bounded_rows(allowed, "label", dict(enumerate(per_class)))
    rows = sample_texts(documents, chosen).orderBy("doc_id").collect()
    if not rows:
        return LatentVotes()
    return LatentVotes().fit([r.text for r in rows], [r.label for r in rows])


def _scorer(model: LatentVotes, documents: DataFrame):
    """Scores of a list of texts, in any task."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    return lambda texts: worker_state(key, lambda: sent.value).score(texts)


def quality(documents: DataFrame, model: LatentVotes, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row, repeated rows and null ids included.

    Null and empty texts score 0. Without any labelled text all others score 0.5. Ties among
    the nearest labelled vectors are cut at ``NEIGHBOURS``. Only ``doc_id`` and ``text`` are
    read; other columns may have any name.
    """
    score = _scorer(model, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            scores = pa.array(score(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_arrow(texts, run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, model: LatentVotes, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score ``threshold`` or more.
    Columns other than ``text`` may be of any kind; they pass through untouched."""
    score = _scorer(model, documents)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            good = score(batch.column(at).to_pylist()) >= threshold
            yield batch.filter(pa.array(good))

    return map_arrow(documents, run, documents.schema)
