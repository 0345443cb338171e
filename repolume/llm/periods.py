"""Periodic runs of words, by catching squares online.

``Squares`` takes words one after the other, in pieces of any size. For each power of two L
it keeps catchers: one for each completed block of L words that begins at a multiple of L.
A block's catcher waits for the same L words to come again 2L - 1 to 4L - 2 words later, so
each word that is appended ends one suffix of L words that two catchers of each size compare
with their blocks. A square of period p holds a completed block of the L with
2L - 1 <= p <= 4L - 2 in its first half, so its catcher sees it. What a catcher has seen is
extended to both sides by suffix comparisons of falling size; squares of one period that
overlap are one run. A stretch that still reaches the last word stays open, and goes on with
the words that are appended next.

Suffixes are compared by 64-bit hashes, built for 2L words from those for L; runs are then
compared word by word, and a text in which that fails is searched by comparing words alone.
Many texts are one stream, parted by words that occur nowhere else: no square crosses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import map_arrow, worker_state
from repolume.llm.hashing import WordHashes, mix

LEAST, TIMES = 24, 3  # words and periods that a run has at least
STREAM_WORDS = 250_000  # words of the texts that are one stream
STREAM_ROWS = 20_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Squares:
    """Runs of at least ``times`` periods (2 or more) and ``least`` words in a stream.

    ``longest`` bounds the periods that are looked for; by default there is no bound."""

    def __init__(self, least: int = LEAST, times: int = TIMES, longest: int | None = None):
        self.least, self.times, self.longest = least, max(2, times), longest
        self.count = 0
        self.hashes: list[np.ndarray] = []  # of windows of 1, 2, 4 .. words, by their start
        self.open = np.zeros((2, 0), np.int64)  # block start and period of open stretches
        self.found: set[tuple[int, int, int]] = set()

    def append(self, words: np.ndarray) -> None:
        """Takes the next words, as 64-bit numbers."""
        if not len(words):
            return
        before, self.count = self.count, self.count + len(words)
        caught = [self.open]
        size, level = 1, 0
        while size <= self.count and (not level or not self.longest or 2 * size - 1 <= self.longest):
            first = max(0, before - size + 1)  # of the windows that end in the new words
            if level == 0:
                fresh = words.astype(np.uint64)
            else:
                half, below = size // 2, self.hashes[level - 1]
                last = self.count - size + 1
                fresh = mix(below[first:last], below[first + half : last + half])
            if level == len(self.hashes):
                self.hashes.append(fresh)
            else:
                self.hashes[level] = np.concatenate([self.hashes[level], fresh])
            if not self.longest or 2 * size - 1 <= self.longest:
                caught.extend(self._advance(level, size, first))
            size, level = size * 2, level + 1
        self._extend(np.concatenate(caught, axis=1))

    def _advance(self, level: int, size: int, first: int) -> Iterator[np.ndarray]:
        """Compares each new suffix with the two blocks whose catchers wait for it."""
        hashes = self.hashes[level]
        place = np.arange(max(first, 2 * size - 1), len(hashes))
        nearest = (place - (2 * size - 1)) // size * size
        for block in (nearest, nearest - size):
            same = hashes[block] == hashes[place]
            if block is not nearest:
                same &= block >= 0
            yield np.stack([block[same], (place - block)[same]])

    def _extend(self, caught: np.ndarray) -> None:
        block, period = caught
        left, right = block.copy(), block.copy()  # the stretch whose words recur a period later
        for level in reversed(range(len(self.hashes))):
            hashes, size = self.hashes[level], 1 << level
            ahead = back = np.arange(len(block))
            while len(ahead) or len(back):
                ahead = ahead[right[ahead] + period[ahead] + size <= self.count]
                ahead = ahead[hashes[right[ahead]] == hashes[right[ahead] + period[ahead]]]
                right[ahead] += size
                back = back[left[back] >= size]
                back = back[hashes[left[back] - size] == hashes[left[back] - size + period[back]]]
                left[back] -= size
                if level < len(self.hashes) - 1:  # only the largest size can fit twice
                    break
        reaches = right + period >= self.count
        # of the open stretches of one start and period one is kept
        still = np.unique(np.stack([left[reaches], period[reaches]]), axis=1)
        self.open = still.astype(np.int64)
        self._report(left[~reaches], right[~reaches], period[~reaches])

    def _report(self, left: np.ndarray, right: np.ndarray, period: np.ndarray) -> None:
        length = right + period - left
        enough = length >= np.maximum(self.least, self.times * period)
        rows = np.stack([left, length, period], axis=1)[enough]
        self.found.update(map(tuple, np.unique(rows, axis=0).tolist()))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of the runs in all words so far, in order."""
        found = set(self.found)
        if self.open.shape[1]:
            closed, self.found = self.found, set()
            left, period = self.open
            self._report(left, np.full_like(left, self.count) - period, period)
            found |= self.found
            self.found = closed
        least: dict[tuple[int, int], int] = {}
        for start, length, period in found:  # a multiple of a period is one too
            key = (start, length)
            least[key] = min(period, least.get(key, period))
        return sorted((s, n, p) for (s, n), p in least.items())


def _holds(words: list[bytes], run: tuple[int, int, int]) -> bool:
    start, length, period = run
    end = start + length
    return (
        words[start : end - period] == words[start + period : end]
        and (start == 0 or words[start - 1] != words[start - 1 + period])
        and (end == len(words) or words[end] != words[end - period])
    )


def by_words(words: list[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs of one text, by comparing its words at each distance."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // times + 1):
        start = 0
        for i in range(period, len(words) + 1):
            if i == len(words) or words[i] != words[i - period]:
                if i - start >= max(least, times * period):
                    found.setdefault((start, i - start), period)
                start = i - period + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def runs_of_texts(texts: list[list[bytes]], least: int, times: int, hashes: WordHashes) -> list:
    """The runs of each text, given as its words."""
    sizes = np.array([len(words) for words in texts], np.int64)
    out: list[list] = [[] for _ in texts]
    long = np.flatnonzero(sizes >= max(least, times))
    if not len(long):
        return out
    parts, begins, at = [], [], 0
    for number, i in enumerate(long.tolist()):
        words = texts[i]
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        parts.append(mix(np.array([number], np.uint64), np.array([at + 1], np.uint64)))
        begins.append(at)
        at += len(words) + 1
    stream = Squares(least, times, int(sizes.max()) // times)
    stream.append(np.concatenate(parts))
    begins = np.array(begins, np.int64)
    for start, length, period in stream.runs():
        row = int(np.searchsorted(begins, start, "right")) - 1
        out[long[row]].append((start - int(begins[row]), length, period))
    for i in long.tolist():
        if out[i] and not all(_holds(texts[i], run) for run in out[i]):
            out[i] = by_words(texts[i], least, times)  # two words of one hash
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in the order of start and
    period), collapsed (the words joined by a space, of each run only its first period) for
    every row.

    A run is a stretch of words with the smallest period q (words q apart are the same) and at
    least ``least`` words and ``times`` periods, which no neighbouring word extends. Words are
    parted by the six white-space characters and compared as they are. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Of runs that overlap each is reported,
    and a word goes if any of them drops it. Repeated rows and null ids are rows of their own;
    an empty table gives no rows. A text is searched whole, in some 8 bytes of memory for each
    word and doubling of its length. Only ``doc_id`` and ``text`` are read.
    """

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        hashes = worker_state("period-words", WordHashes)
        found = runs_of_texts(texts, least, times, hashes)
        many = np.cumsum([0] + [len(runs) for runs in found])
        flat = [run for runs in found for run in runs]
        fields = [pa.array([run[k] for run in flat], pa.int64()) for k in range(3)]
        items = pa.StructArray.from_arrays(fields, fields=list(RUN))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(words) for words in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(many, pa.int32()), items),
                pa.array([collapsed(*pair) for pair in zip(texts, found)], pa.binary()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                ids.append(doc_id)
                texts.append((text or b"").split())
                held += len(texts[-1])
                if held >= STREAM_WORDS or len(ids) >= STREAM_ROWS:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)

    text = documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")
    )
    schema = (
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
        "collapsed binary"
    )
    return map_arrow(text, run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
