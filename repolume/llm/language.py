"""Language by unigrams of vocabulary pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text scores
the sum over all ways to cut it into pieces, which a forward pass adds up. The vocabulary has
no piece that crosses a space, so a text is the product of its words, and a word is worked out
once for each worker. Letters outside the vocabulary go through its byte pieces.

The probabilities are learnt by expectation-maximisation: tasks add up the expected uses of
each piece (forward and backward pass over the distinct words), Spark sums them by piece, and
the driver holds one table of vocabulary x languages, whose size the vocabulary bounds.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import bounded_rows, fold, map_arrow, sample_texts, worker_state, written

VOCABULARY = "piece_bpe_32k.model"
# Learnt texts of each language, at most, and languages, at most (the most frequent).
PER_LANGUAGE = 1500
LANGUAGES = 200
ROUNDS = 3
SMOOTHING = 0.05
KEPT_WORDS = 300_000
UNKNOWN = "und"
# Runs of letters (and the few digits that are no decimal digits, dropped below).
WORD = re.compile(r"[^\W\d_]+")
TINY, SHIFT = 1e-200, 1e200
MARK = "\u2581"  # stands before each word in the vocabulary
MULTIPLIER = 0x9E3779B97F4A7C15
# Words are worked on together with others of like length; longer ones one by one.
WIDTHS = (6, 10, 16, 26, 64, 160)
LONGEST_LEARNT = 40


def vocabulary(path: str) -> dict[str, int]:
    """Pieces to ids; byte pieces have their names, such as <0x41>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not model.is_control(i) and not model.is_unknown(i)
    }


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Lattice:
    """All cuts of words into pieces.

    Pieces are found by a hash of their characters, for all places of many words at once;
    the passes go along the words, adding the logs of all languages together.
    """

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(list(map(ord, p))) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(list(pieces.values()), np.int64)[order]
        self.bytes = np.array([pieces[f"<0x{b:02X}>"] for b in range(256)])

    @staticmethod
    def _hash(codes: list[int]) -> int:
        h = 0
        for n, code in enumerate(codes, 1):
            h = (h * MULTIPLIER + code + n) & 0xFFFFFFFFFFFFFFFF
        return h

    def log_probability(self, word: str, p: list[float]) -> float:
        """Log of the sum over all cuts of one word of any length, place by place."""
        marked, pieces = MARK + word, self.pieces
        alpha, scale = [1.0] + [0.0] * len(marked), 0.0
        for end in range(1, len(alpha)):
            total = 0.0
            for start in range(max(0, end - self.longest), end):
                if (piece := pieces.get(marked[start:end])) is not None:
                    total += alpha[start] * p[piece]
                elif end - start == 1:
                    total += alpha[start] * math.prod(
                        p[self.bytes[b]] for b in marked[start:end].encode()
                    )
            alpha[end] = total
            if total < TINY:  # the places still to be read leave the range of a double
                for i in range(max(0, end - self.longest), end + 1):
                    alpha[i] *= SHIFT
                scale -= math.log(SHIFT)
        return math.log(max(alpha[-1], 5e-324)) + scale

    def _codes(self, words: list[str]) -> np.ndarray:
        """Words x places: characters after the mark of a word's start, then zeros."""
        size = np.array([len(w) + 1 for w in words])
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(words), int(size.max())), np.uint64)
        codes[np.arange(codes.shape[1]) < size[:, None]] = flat
        return codes

    def _pieces(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length n - 1, words x places: the piece of n characters that starts there,
        or -1; at n = 1 also -1 - code for a letter that goes through its bytes."""
        out = []
        running = np.zeros(codes.shape, np.uint64)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            shifted = np.zeros(codes.shape, np.uint64)
            shifted[:, : codes.shape[1] - n + 1] = codes[:, n - 1 :]
            running = running * np.uint64(MULTIPLIER) + shifted + np.uint64(n)
            at = np.minimum(np.searchsorted(self.keys, running), len(self.keys) - 1)
            found = np.where((self.keys[at] == running) & (shifted > 0), self.ids[at], -1)
            if n == 1:
                lost = (found < 0) & (codes > 0)
                found[lost] = -1 - codes[lost].astype(np.int64)
            out.append(found)
        return out

    def _weights(self, found: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Words x languages: log probability of the piece found at a place."""
        weight = np.where((found >= 0)[:, None], logs[np.maximum(found, 0)], -np.inf)
        for code in np.unique(found[found < -1]).tolist():
            coded = self.bytes[list(chr(-1 - code).encode())]
            weight[found == code] = logs[coded].sum(axis=0)
        return weight

    def _forward(self, found: list, logs: np.ndarray) -> np.ndarray:
        words, places = found[0].shape
        alpha = np.full((places + 1, words, logs.shape[1]), -np.inf)
        alpha[0] = 0.0
        for end in range(1, places + 1):
            for n in range(1, min(len(found), end) + 1):
                if (found[n - 1][:, end - n] != -1).any():
                    step = self._weights(found[n - 1][:, end - n], logs)
                    alpha[end] = np.logaddexp(alpha[end], alpha[end - n] + step)
        return alpha

    def log_probabilities(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Words x languages, from the logs of piece probabilities (pieces x languages)."""
        out = np.zeros((len(words), logs.shape[1]))
        size = np.array([len(w) for w in words])
        least = 0
        for most in WIDTHS:
            rows = np.flatnonzero((size > least) & (size <= most))
            least = most
            if len(rows):
                chosen = [words[r] for r in rows]
                with np.errstate(invalid="ignore"):
                    alpha = self._forward(self._pieces(self._codes(chosen)), logs)
                out[rows] = alpha[size[rows] + 1, np.arange(len(rows))]
        for row in np.flatnonzero(size > least):
            for lang, p in enumerate(np.exp(logs).T.tolist()):
                out[row, lang] = self.log_probability(words[row], p)
        return out

    def expected(self, words: list[str], counts: list[int], logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all cuts, for one language, weighed by counts.
        Words are at most ``LONGEST_LEARNT`` letters."""
        uses = np.zeros(len(logs))
        size = np.array([len(w) for w in words])
        counts = np.asarray(counts, float)
        least = 0
        for most in WIDTHS:
            rows = np.flatnonzero((size > least) & (size <= most))
            least = most
            if len(rows):
                found = self._pieces(self._codes([words[r] for r in rows]))
                self._add_uses(found, size[rows] + 1, counts[rows], logs[:, None], uses)
        return uses

    def _add_uses(self, found, ends, counts, logs, uses) -> None:
        with np.errstate(invalid="ignore"):
            alpha = self._forward(found, logs)[:, :, 0]
            beta = np.full(alpha.shape, -np.inf)
            beta[ends, np.arange(len(ends))] = 0.0
            whole = alpha[ends, np.arange(len(ends))]
            for start in range(len(alpha) - 2, -1, -1):
                for n in range(1, min(len(found), len(alpha) - 1 - start) + 1):
                    piece = found[n - 1][:, start]
                    if not (piece != -1).any():
                        continue
                    step = self._weights(piece, logs)[:, 0] + beta[start + n]
                    beta[start] = np.logaddexp(beta[start], step)
                    share = np.nan_to_num(np.exp(alpha[start] + step - whole)) * counts
                    known = piece >= 0
                    np.add.at(uses, piece[known], share[known])
                    for code in np.unique(piece[piece < -1]).tolist():
                        coded = self.bytes[list(chr(-1 - code).encode())]
                        np.add.at(uses, coded, share[piece == code].sum())


class PieceUnigrams:
    """Languages, their log priors, and probabilities of pieces (languages x vocabulary)."""

    def __init__(self, languages: list[str], path: str):
        self.languages, self.path = languages, path
        self.prior = np.zeros(len(languages))
        self.table = np.zeros((len(languages), 0))


def fit_language(
    documents: DataFrame, per_language: int = PER_LANGUAGE, path: str | None = None
) -> PieceUnigrams:
    """Learns from rows with text and language whose crc32(doc_id) modulo 3 is not 1, at most
    ``per_language`` of each of the ``LANGUAGES`` most frequent languages, whole texts but for
    runs of more than ``LONGEST_LEARNT`` letters."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = documents.sparkSession
    known = documents.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 3) != 1)
    ).select("doc_id", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    model = PieceUnigrams(sorted(found), path)
    if not found:
        return model
    total = sum(found.values())
    model.prior = np.log([found[lang] / total for lang in model.languages])
    pieces = vocabulary(path)
    size = max(pieces.values()) + 1
    model.table = np.full((len(model.languages), size), 1.0 / size)

    chosen = bounded_rows(known, "lang", {lang: per_language for lang in model.languages})
    words = sample_texts(documents, chosen).select("label", F.lower("text").alias("text"))
    words = words.select(
        "label", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), 1)).alias("word")
    )
    words = words.where(F.length("word") <= LONGEST_LEARNT).groupBy("label", "word").count()
    words = written(spark, words, "language-words").repartition("word")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.languages, np.log(model.table).T))
        used = map_arrow(words, _expectation(sent, path), "lang int, piece int, uses double")
        rows = used.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.full_like(model.table, SMOOTHING)
        table[rows["lang"], rows["piece"]] += rows["uses"]
        model.table = table / table.sum(axis=1, keepdims=True)
        sent.unpersist()
    return model


def _expectation(sent, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_state(path, lambda: Lattice(vocabulary(path)))
        languages, logs = sent.value
        uses = np.zeros(logs.shape)
        for batch in batches:
            own = defaultdict(lambda: ([], []))
            for lang, word, count in zip(*(c.to_pylist() for c in batch.columns)):
                own[lang][0].append(word)
                own[lang][1].append(count)
            for lang, (words, counts) in own.items():
                at = languages.index(lang)
                uses[:, at] += lattice.expected(words, counts, logs[:, at])
        piece, lang = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lang, pa.int32()),
                pa.array(piece, pa.int32()),
                pa.array(uses[piece, lang]),
            ],
            names=["lang", "piece", "uses"],
        )

    return run


class _Words:
    """Log probability by language of each distinct word met so far."""

    def __init__(self, model: PieceUnigrams):
        self.lattice = Lattice(vocabulary(model.path))
        self.piece_logs = np.log(model.table).T
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, self.piece_logs.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        logs = self.lattice.log_probabilities(new, self.piece_logs)
        logs[[not any(map(str.isalpha, w)) for w in new]] = 0.0
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.logs = np.concatenate([self.logs, logs])


def _predict(texts: list[str | None], words: _Words, model: PieceUnigrams):
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    labels, scores = [], []
    for at in range(0, len(texts), 500):
        parts = [words_of(t) for t in texts[at : at + 500]]
        if len(words.place) > KEPT_WORDS:
            words.forget()
        words.learn({w for p in parts for w in p})
        for text, part in zip(texts[at : at + 500], parts):
            if not text or not any(map(str.isalpha, text)):
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            places = np.fromiter(map(words.place.__getitem__, part), np.int64, len(part))
            total = words.logs[places].sum(axis=0) + model.prior
            best = int(total.argmax())
            labels.append(model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return labels, scores


def language(documents: DataFrame, model: PieceUnigrams) -> DataFrame:
    """doc_id, lang_pred, score (the probability of that language) for every row.

    A null text, a text without a letter, and any text when nothing could be learnt get
    ``und`` with score 0. Equal scores go to the language first in order. Only ``doc_id`` and
    ``text`` are read; other columns may have any name.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(key, lambda: _Words(sent.value))
        for batch in batches:
            labels, scores = _predict(batch.column(1).to_pylist(), words, sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(texts, run, "doc_id long, lang_pred string, score double")
