"""Toxicity by subword bags.

A word is the bag of its character n-grams (3 to 5, with marks for its ends) and itself.
Their embeddings are averaged over the text, and a linear softmax reads the average.
Embeddings and softmax are trained jointly, in numpy, on a bounded sample of labelled
texts. A misspelling that was never seen shares most n-grams with the word it is made from.

The average is linear, so a trained n-gram comes down to one number, its share in the
difference of the two logits, and a word to the sum over its n-grams and their count.
Both are worked out once for each distinct word of a worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import bounded_rows, fold, map_arrow, one_label, sample_texts, worker_state

BUCKETS = 1 << 18
# Distinct words whose numbers a worker keeps.
KEPT_WORDS = 400_000
# Labelled texts that a model is fitted on, at most: of class 0 and of class 1.
PER_CLASS = (4500, 1500)
EDGES = ".,;:!?#$%&*|<>\"'()[]{}"
# The average of hundreds of n-grams is short; the softmax reads it times this number.
SCALE = 100.0


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all ``words``, word after word, and their number for each
    word: none for a word of punctuation alone."""
    marked = [f"<{w}>" if (w := word.strip(EDGES)) else "" for word in words]
    size = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    running = np.zeros(len(codes), np.uint64)
    buckets, owners = [], []
    for n in range(1, 6):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        running = running * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        if n >= 3:
            fits = at + n <= end
            buckets.append(running[fits])
            owners.append(owner[fits])
    # the whole word: its characters, weighed by their place
    if len(codes):
        place = at - (end - np.repeat(size, size))
        weighed = codes * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
        weighed *= np.uint64(0xC2B2AE3D27D4EB4F)
        weighed ^= weighed >> np.uint64(31)
        some = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[some]
        buckets.append(np.add.reduceat(weighed, starts) + np.uint64(0x165667B19E3779F9))
        owners.append(some)
    flat, owner = np.concatenate(buckets), np.concatenate(owners)
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    flat = (flat >> np.uint64(32)).astype(np.int64) % BUCKETS
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(words))


class SubwordSoftmax:
    """Averaged n-gram embeddings under a softmax of two classes, by Adagrad."""

    def __init__(
        self, dim: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 0.05,
        least: int = 3, seed: int = 7,
    ):
        self.dim, self.epochs, self.rate, self.seed = dim, epochs, rate, seed
        self.decay, self.least = decay, least
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), 0.0

    @staticmethod
    def _bags(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, shares = [], []
        for text in texts:
            flat, _ = word_ngrams(words_of(text))
            bucket, count = np.unique(flat, return_counts=True)
            ids.append(bucket)
            shares.append((count / max(1, len(flat))).astype(np.float32))
        return ids, shares

    def fit(self, texts: list[str], labels: list[int]) -> SubwordSoftmax:
        labels = np.asarray(labels, np.int64)
        if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of the class
            self.bias = 0.0 if not len(labels) else (8.0 if labels[0] else -8.0)
            return self
        ids, shares = self._bags(texts)
        seen = np.zeros(BUCKETS, np.int32)
        for bucket in ids:
            seen[bucket] += 1
        # n-grams of one or two texts say nothing about others
        common = seen >= min(self.least, max(1, len(texts) // 4))
        shares = [s[common[b]] for b, s in zip(ids, shares)]
        ids = [b[common[b]] for b in ids]
        place = np.cumsum(common) - 1
        ids = [place[b] for b in ids]
        used = np.flatnonzero(common)

        random = np.random.default_rng(self.seed)
        embed = random.normal(0, 0.1, (len(used), self.dim)).astype(np.float32)
        soft = random.normal(0, 0.1, (self.dim, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        embed_sq = np.full(len(used), 1e-6, np.float32)
        soft_sq, bias_sq = np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
        # both classes weigh the same, whatever their share in the sample
        balance = len(labels) / (2.0 * np.bincount(labels, minlength=2))
        batch = 32
        for epoch in range(self.epochs):
            order = random.permutation(len(texts))
            rate = self.rate * (1 - epoch / self.epochs) + 0.01
            for at in range(0, len(order), batch):
                rows = [r for r in order[at : at + batch] if len(ids[r])]
                if not rows:
                    continue
                flat = np.concatenate([ids[r] for r in rows])
                share = np.concatenate([shares[r] for r in rows])[:, None] * SCALE
                starts = np.cumsum([0] + [len(ids[r]) for r in rows[:-1]])
                hidden = np.add.reduceat(embed[flat] * share, starts, axis=0)
                logits = hidden @ soft + bias
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                truth = labels[rows]
                p[np.arange(len(rows)), truth] -= 1
                p *= (balance[truth] / len(rows))[:, None].astype(np.float32)
                soft_g, bias_g = hidden.T @ p, p.sum(axis=0)
                back = np.repeat(p @ soft.T, [len(ids[r]) for r in rows], axis=0) * share
                where, inverse = np.unique(flat, return_inverse=True)
                embed_g = np.zeros((len(where), self.dim), np.float32)
                np.add.at(embed_g, inverse, back)
                embed_sq[where] += (embed_g**2).mean(axis=1)
                step = rate * embed_g / np.sqrt(embed_sq[where])[:, None]
                embed[where] = embed[where] * np.float32(1 - rate * self.decay) - step
                soft_sq += soft_g**2
                soft -= rate * soft_g / np.sqrt(soft_sq)
                bias_sq += bias_g**2
                bias -= rate * bias_g / np.sqrt(bias_sq)
        self.weights[used] = embed @ (soft[:, 1] - soft[:, 0]) * SCALE
        self.bias = float(bias[1] - bias[0])
        return self


class _Words:
    """(sum, count) of each distinct word met so far."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = self.counts = np.zeros(0)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        flat, count = word_ngrams(new)
        owner = np.repeat(np.arange(len(new)), count)
        sums = np.bincount(owner, self.weights[flat], minlength=len(new))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.sums = np.concatenate([self.sums, sums])
        self.counts = np.concatenate([self.counts, count])


def _score(texts: list[str | None], words: _Words, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for at in range(0, len(texts), 500):
        parts = [words_of(t) for t in texts[at : at + 500]]
        if len(words.place) > KEPT_WORDS:
            words.forget()
        words.learn({w for p in parts for w in p})
        for i, part in enumerate(parts, at):
            places = np.fromiter(map(words.place.__getitem__, part), np.int64, len(part))
            if grams := words.counts[places].sum():
                out[i] += words.sums[places].sum() / grams
    return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_class: tuple = PER_CLASS):
    """A model from labelled rows whose crc32(doc_id) modulo 5 is not 0, at most
    ``per_class`` of classes 0 and 1. Without a labelled text the model scores 0.5."""
    allowed = one_label(labels, "toxic").where(fold("doc_id", 5) != 0)
    chosen = bounded_rows(allowed, "label", dict(enumerate(per_class)))
    rows = sample_texts(documents, chosen).orderBy("doc_id").collect()
    return SubwordSoftmax().fit([r.text for r in rows], [r.label for r in rows])


def toxicity(documents: DataFrame, model: SubwordSoftmax, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row, repeated rows and null ids included.

    Null and empty texts, and texts of punctuation alone, have no n-gram and get the score
    of the bias alone. Only ``doc_id`` and ``text`` are read; other columns may have any name.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.bias))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        words = worker_state(key, lambda: _Words(weights))
        for batch in batches:
            score = _score(batch.column(1).to_pylist(), words, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score)], names=["doc_id", "score"]
            )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_arrow(texts, run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
