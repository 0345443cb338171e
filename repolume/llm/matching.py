"""Log probabilities of texts by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes, with the counts of the bytes
that followed each in the training texts. A byte is predicted in its longest known context;
where it never followed there, the model escapes to the context one byte shorter, and the
bytes that the longer one knows are excluded (a byte has count / (total + distinct), the
escape distinct / (total + distinct), both without the excluded). Below the empty context
all bytes that are left are alike. A text begins in a context of zero bytes and ends in the
byte END, which no UTF-8 text holds, so the probabilities of all texts sum to at most one.

All of the training part makes the trie, and it is nowhere whole. A gram is a context of
ORDER bytes and the byte after it: the code length of a byte is that of its gram, so it is
computed once for each distinct gram and not for each place.

1. Texts are dealt into runs of some megabytes, kept as a table. A text longer than a run is
   cut after white space, and each piece keeps the bytes before it as its context.
2. Each run gives its distinct grams and words with their counts in its training texts.
3. Counts are summed by gram and by word. A trie's contexts that end in the same two bytes
   meet in one task with all their longer contexts; contexts of one byte and none are a table
   of 256 x 256 counts. That task gives each gram its log probability.
4. The results are joined back to the runs that asked for them, and each run adds up its
   texts. Rows are one per run and distinct gram or word, so a frequent one is no hot key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.llm.common import map_arrow, ship, written
from repolume.llm.hashing import arrays_of, blob_of

ORDER = 4
END = 255
END_WORD = b" "  # stands for the end of a text among its words; no word has a space
SYMBOLS = 256
RUN_BYTES, PIECE_BYTES = 16 << 20, 4 << 20
RUN_ROWS = 200_000
PART_GRAMS = 1_000_000  # grams of one part of the trie, about
SCORED_BYTES = 1 << 20  # scored at once

RUNS = "run long, head binary, bytes binary"
SMOOTH = 0.1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mask(bytes_: int) -> np.uint64:
    return np.uint64((1 << 8 * bytes_) - 1)


def grams_of(data: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The grams of pieces that stand one after the other, each behind its context: a number
    of ``order + 1`` bytes for each byte of a piece without its context. Made some pieces at a
    time, so that little is held beside the result."""
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()) - order * len(sizes), np.uint64)
    at = done = 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + SCORED_BYTES, "right")))
        end = int(ends[to - 1])
        padded = np.concatenate([data[begin:end], np.zeros(8, np.uint8)])
        # the eight bytes from each place on, of which the first are the gram
        codes = np.ndarray((end - begin - order,), ">u8", padded, strides=(1,)).astype(np.uint64)
        codes >>= np.uint64(64 - 8 * (order + 1))
        # windows that end in a context belong to no piece
        keep = np.ones(len(codes), bool)
        inner = ends[at : to - 1] - begin
        for k in range(order):
            keep[inner - order + k] = False
        codes = codes[keep]
        out[done : done + len(codes)] = codes
        at, done = to, done + len(codes)
    return out


class Level:
    """Contexts of one length, the bytes that follow them, and what escaping to them costs."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = rows, counts  # rows: context and byte, in rising order
        owner = rows >> np.uint64(8)
        self.begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(rows) else (
            np.zeros(0, np.int64)
        )
        self.contexts = owner[self.begins]
        self.totals = self.add(counts)
        self.distinct = np.diff(np.append(self.begins, len(rows)))

    def add(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.begins) if len(self.begins) else values[:0]

    def places(self, wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``wanted`` stands in the rising ``keys``, and whether it is there."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


def levels_of(grams: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> list[Level]:
    """The trie's levels 0 to ``order``; ``low`` is the table of byte pairs of all texts."""
    known = counts > 0
    rows, counts = grams[known], counts[known]
    out: list = [None] * (order + 1)
    for k in range(order, 1, -1):
        if k < order:
            rows = rows & _mask(k + 1)
            order_of = np.argsort(rows, kind="stable")
            rows, counts = rows[order_of], counts[order_of]
            if len(rows):
                begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                rows, counts = rows[begins], np.add.reduceat(counts, begins)
        out[k] = Level(rows, counts)
    pairs = low.reshape(-1)
    for k, table in ((1, pairs), (0, low.sum(axis=0))):
        if k <= order:
            some = np.flatnonzero(table)
            out[k] = Level(some.astype(np.uint64), table[some])
    return out


def log_probabilities(
    grams: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int
) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others. ``grams`` rise; a
    count of 0 says that the gram is asked for and was not learnt. All learnt grams that end
    in the same two context bytes are there."""
    levels = levels_of(grams, counts.astype(np.int64), low, order)
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    before = np.full(len(grams), -1)  # place of the longer context, if it is known
    excluded = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # of each longer context
    for k in range(order, -1, -1):
        level = levels[k]
        codes = grams[left] & _mask(k + 1)
        context, known = level.places(codes >> np.uint64(8), level.contexts)
        row, there = level.places(codes, level.rows)
        if known.any():
            total = np.where(known, level.totals[context], 0)
            distinct = np.where(known, level.distinct[context], 0)
            came = before[left] >= 0
            total[came] -= excluded[0][before[left][came]]
            distinct[came] -= excluded[1][before[left][came]]
            there &= known
            whole = np.where(distinct > 0, total + distinct, 1)
            part = np.where(distinct > 0, distinct, 1)  # nothing to escape from: no cost
            if there.any():
                part[there] = level.counts[row[there]]
            out[left] += np.where(known, np.log10(part) - np.log10(whole), 0.0)
            before[left] = np.where(known, context, -1)
        if k:
            parent, _ = levels[k - 1].places(level.rows & _mask(k), levels[k - 1].rows)
            shorter = levels[k - 1].counts
            excluded = (
                level.add(shorter[parent]) if len(level.rows) else np.zeros(0, np.int64),
                level.distinct,
            )
        left = left[~there]
    out[left] -= math.log10(max(1, SYMBOLS - len(levels[0].rows)))
    return out


def _pieces(text: bytes, order: int, most: int) -> Iterator[tuple[bytes, bytes, bool]]:
    """(context, bytes, whether the text ends there): a text in pieces of about ``most`` bytes,
    cut after white space."""
    at, size = 0, len(text)
    while True:
        end = size
        if size - at > most:
            space = SPACE.search(text, at + most)
            end = space.end() if space else size
        context = text[max(0, at - order) : at].rjust(order, b"\0")
        yield context, text[at:end], end == size
        if end == size:
            return
        at = end


def _lower(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes: A-Z alone


def runs_of(documents: DataFrame, held_out: Column, order: int) -> DataFrame:
    """run, head (row, doc_id, null id, held out, last piece, size of each piece), bytes (the
    pieces behind their contexts, compressed)."""

    def batch_of(run: int, head: list, parts: list[bytes]) -> pa.RecordBatch:
        columns = [np.array(column, np.int64) for column in zip(*head)]
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([run], pa.int64()),
                pa.array([blob_of(*columns)], pa.binary()),
                pa.array([data], pa.binary()),
            ],
            names=["run", "head", "bytes"],
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        run, row, head, parts, held = first, first, [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(column.to_pylist() for column in batch.columns)):
                for context, piece, last in _pieces(_lower(text), order, min(PIECE_BYTES, RUN_BYTES)):
                    piece = context + piece + bytes([END]) * last
                    head.append((row, doc_id or 0, doc_id is None, out, last, len(piece)))
                    parts.append(piece)
                    held += len(piece)
                    if held >= RUN_BYTES or len(head) >= RUN_ROWS:
                        yield batch_of(run, head, parts)
                        run, head, parts, held = run + 1, [], [], 0
                row += 1
        if head:
            yield batch_of(run, head, parts)

    rows = documents.select(
        F.col("doc_id").cast("long"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    return map_arrow(rows, deal, RUNS)


def _opened(head: bytes, data: bytes) -> tuple[list[np.ndarray], bytes]:
    return arrays_of(head), zstandard.ZstdDecompressor().decompress(data)


def _words(data: bytes, sizes: np.ndarray, last: np.ndarray, order: int) -> Iterator[list[bytes]]:
    at = 0
    for size, ends in zip(sizes.tolist(), last.tolist()):
        words = data[at + order : at + size - ends].split()
        if ends:
            words.append(END_WORD)
        yield words
        at += size


def asked_of(runs: DataFrame, order: int) -> DataFrame:
    """run, gram, word, n: the distinct grams (word null) and words (gram null) of each run, and
    how often they are in its training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, head, data in zip(*(column.to_pylist() for column in batch.columns)):
                (_, _, _, out, last, sizes), text = _opened(head, data)
                codes = grams_of(np.frombuffer(text, np.uint8), sizes, order)
                # the lowest bit says whether the gram is to be learnt
                codes <<= np.uint64(1)
                codes |= np.repeat((1 - out).astype(np.uint8), sizes - order)
                codes.sort()
                edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                times = np.diff(np.append(edges, len(codes)))
                codes = codes[edges]
                times[codes & np.uint64(1) == 0] = 0
                codes >>= np.uint64(1)
                edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                codes, times = codes[edges], np.add.reduceat(times, edges)
                learnt: Counter = Counter()
                others: set = set()
                for held, words in zip(out.tolist(), _words(text, sizes, last, order)):
                    if held:
                        others.update(words)
                    else:
                        learnt.update(words)
                others.difference_update(learnt)
                words = [*learnt, *others]
                counts = np.zeros(len(words), np.int64)
                counts[: len(learnt)] = np.fromiter(learnt.values(), np.int64, len(learnt))
                yield from _asked(run, codes, None, times)
                yield from _asked(run, None, words, counts)

    schema = "run long, gram long, word binary, n long"
    return map_arrow(runs, ask, schema)


def _asked(run: int, grams, words, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(counts), 50_000):
        size = min(50_000, len(counts) - a)
        none = pa.nulls(size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, run, np.int64)),
                none.cast(pa.int64()) if grams is None else pa.array(grams[a : a + size].astype(np.int64)),
                none.cast(pa.binary()) if words is None else pa.array(words[a : a + size], pa.binary()),
                pa.array(counts[a : a + size].astype(np.int64)),
            ],
            names=["run", "gram", "word", "n"],
        )


def trie_of(counts: DataFrame, order: int) -> DataFrame:
    """gram, value: the log probability of each gram of ``counts`` (gram, n)."""
    pair = F.col("gram").bitwiseAND(0xFFFF)
    # 65,536 rows at most
    pairs = counts.where("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect()
    low = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for row in pairs:
        low[row["pair"] >> 8, row["pair"] & 0xFF] = row["n"]
    parts = max(8, -(-counts.count() // PART_GRAMS))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        grams = np.concatenate([g for g, _ in held]).astype(np.uint64)
        many = np.concatenate([n for _, n in held])
        order_of = np.argsort(grams)
        grams, many = grams[order_of], many[order_of]
        values = log_probabilities(grams, many, low, order)
        for a in range(0, len(grams), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[a : a + 50_000].astype(np.int64)), pa.array(values[a : a + 50_000])],
                names=["gram", "value"],
            )

    ending = F.shiftrightunsigned("gram", 8).bitwiseAND(0xFFFF)
    dealt = counts.select("gram", "n").repartition(parts, ending)
    return map_arrow(dealt, solve, "gram long, value double")


def text_scores(documents: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from the rows for which ``held_out`` is not true, and scores all. A-Z count
    as lower case. ``score`` is log10 of the model's probability of the text; ``base_score``
    the sum, over the text's words and one end, of log10((c + 0.1) / (N + 0.1 * (V + 1))), with
    c the token's count in the training texts, N that of all tokens there and V of distinct
    ones; ``n_known`` counts tokens with c > 0.

    Null and empty texts are an end alone. Very long texts are scored whole, in pieces. Repeated
    rows count each, in learning and scoring, and have equal scores. Without training texts
    all bytes are alike and every token has a base score of 0. An empty table gives no rows. A
    null id is not held out, if ``held_out`` is null for it. ``order`` is 1 to 6. Only
    ``doc_id``, ``text`` and the columns of ``held_out`` are read.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = documents.sparkSession
    runs = written(spark, runs_of(documents, held_out, order), "text-runs")
    asked = written(spark, asked_of(runs, order), "asked-grams", "zstd")
    grams, words = asked.where("gram IS NOT NULL"), asked.where("word IS NOT NULL")

    counts = written(spark, grams.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    values = written(spark, trie_of(counts, order), "gram-values")
    tokens = words.agg(F.sum("n")).first()[0] or 0
    # a word has a row for each run; one of them counts it among the distinct words
    same = Window.partitionBy("word")
    none = F.lit(None)
    told = (
        grams.join(values, "gram")
        .select("run", "gram", none.cast("binary").alias("word"), "value", F.lit(False).alias("first"))
        .unionByName(
            words.select(
                "run",
                none.cast("long").alias("gram"),
                "word",
                F.sum("n").over(same).cast("double").alias("value"),
                (F.col("run") == F.min("run").over(same)).alias("first"),
            )
        )
    )

    def score(runs_: pa.Table, told_: pa.Table) -> pa.Table:
        (row, ids, no_id, out, last, sizes), text = _opened(
            runs_.column("head")[0].as_py(), runs_.column("bytes")[0].as_py()
        )
        is_gram = told_.column("gram").is_valid()
        of_grams = told_.filter(is_gram)
        keys = pd.Index(of_grams.column("gram").to_numpy())
        logs = of_grams.column("value").to_numpy()
        of_words = told_.filter(told_.column("word").is_valid())
        place = {word: i for i, word in enumerate(of_words.column("word").to_pylist())}
        count = of_words.column("value").to_numpy()
        log_counts = np.log10(count + SMOOTH)
        fresh = np.zeros(len(sizes), np.int64)
        fresh[0] = int((of_words.column("first").to_numpy() & (count > 0)).sum())
        data = np.frombuffer(text, np.uint8)
        ends = np.cumsum(sizes)
        scores = np.zeros(len(sizes))
        at = 0
        while at < len(sizes):  # some pieces at a time
            begin = int(ends[at] - sizes[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + SCORED_BYTES, "right")))
            codes = grams_of(data[begin : int(ends[to - 1])], sizes[at:to], order)
            found = logs[keys.get_indexer(codes.view(np.int64))]
            many = sizes[at:to] - order  # at least one byte, or the end
            scores[at:to] = np.add.reduceat(found, np.cumsum(many) - many)
            at = to
        n_tokens, places = [], []
        for words in _words(text, sizes, last, order):
            n_tokens.append(len(words))
            places.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        base, n_known = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        some = np.flatnonzero(n_tokens)
        if len(some):
            flat, many = np.concatenate(places), np.array(n_tokens)[some]
            starts = np.cumsum(many) - many
            base[some] = np.add.reduceat(log_counts[flat], starts)
            n_known[some] = np.add.reduceat((count[flat] > 0).astype(np.int64), starts)
        return pa.table(
            {
                "row": pa.array(row, pa.int64()),
                "doc_id": pa.array(ids, pa.int64(), mask=no_id.astype(bool)),
                "held_out": pa.array(out.astype(bool)),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores, pa.float64()),
                "fresh": pa.array(fresh, pa.int64()),
            }
        )

    ship(spark)
    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double, fresh long"
    )
    pieces = runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(score, schema)
    pieces = written(spark, pieces, "piece-scores")
    distinct = pieces.agg(F.sum("fresh")).first()[0] or 0
    whole = math.log10(tokens + SMOOTH * (distinct + 1))
    added = ("n_tokens", "n_known", "base_score", "score")
    texts = pieces.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in added))
    return texts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )
