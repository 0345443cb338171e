"""Words of texts, counted by Python workers; each text is read once.

The words are those of Spark ML's ``RegexTokenizer`` with ``TOKEN``, which a saved pipeline has:
runs of two or more word characters, in any script, of the text in lower case. The JVM tells which
characters it takes for word characters; Python's ``\\w`` has fewer marks and more numerals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.operators import softmax
from repolume.workers import ship

# Words of two or more characters, in any script.
TOKEN = r"(?U)\w\w+"
BLOCK_WORDS = 250_000  # a block ends with the text that brings its words to as many
_RANGES: list[tuple[int, int]] = []


def word_ranges(spark: SparkSession) -> list[tuple[int, int]]:
    """The characters that ``TOKEN`` takes, as ranges of code points; asked for once."""
    if not _RANGES:
        matcher = spark._jvm.java.util.regex.Pattern.compile(r"(?U)\w+").matcher(
            "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        )
        # a run of characters that follow each other in that text
        found = []
        while matcher.find():
            found.append(matcher.group())
        for run in found:
            codes = np.frombuffer(run.encode("utf-32-le"), np.uint32)
            for part in np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1):
                _RANGES.append((int(part[0]), int(part[-1])))
    return _RANGES


def splitter(ranges: list[tuple[int, int]]) -> Callable[[str], list[str]]:
    """The function from a text to its words.

    Most texts are ASCII or have no character beyond the first 65,536, for which a class of
    characters is one look-up; only other texts pay for going through its further ranges.
    """

    def runs(below: int) -> Callable[[str], list[str]]:
        parts = (
            f"{re.escape(chr(a))}-{re.escape(chr(min(b, below)))}" for a, b in ranges if a <= below
        )
        return re.compile(f"[{''.join(parts)}]{{2,}}").findall

    plain, basic, every = runs(0x7F), runs(0xFFFF), None

    def words(text: str) -> list[str]:
        nonlocal every
        text = text.lower()
        if text.isascii():
            return plain(text)
        if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return basic(text)
        every = every or runs(0x10FFFF)
        return every(text)

    return words


class _Places(dict):
    """Places of words: of those of a block as they come, or of those given alone. Words that are
    left out have the place -1."""

    def __init__(self, places: dict[str, int], grows: bool):
        super().__init__(places)
        self.grows, self.words = grows, []

    def __missing__(self, word: str) -> int:
        if not self.grows:
            return -1
        self[word] = at = len(self.words)
        self.words.append(word)
        return at


def counted_batches(
    texts: Iterable[str | None], words_of: Callable[[str], list[str]], places: dict[str, int], grows: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For some texts at a time, until all are counted: the number of different words of each text,
    their places and how often they come; and the words of the block if ``grows``."""
    known, lengths, found_places, found_counts = _Places(places, grows), [], [], []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        place, count = np.array(found_places, np.int32), np.array(found_counts, np.int32)
        kept = place >= 0
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], np.cumsum(kept)])
        length = before[ends] - before[ends - lengths]
        return length.astype(np.int32), place[kept], count[kept], known.words

    for text in texts:
        found = Counter(words_of(text or ""))
        lengths.append(len(found))
        found_places.extend(map(known.__getitem__, found))
        found_counts.extend(found.values())
        if len(found_places) >= BLOCK_WORDS:
            yield block()
            known, lengths, found_places, found_counts = _Places(places, grows), [], [], []
    if lengths:
        yield block()


def _bytes(values: np.ndarray) -> bytes:
    """Counts and places, none negative, in as few bytes each as the largest takes."""
    return values.astype(np.min_scalar_type(values.max(initial=0))).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1")


def counted(rows: DataFrame, stop_words: list[str]) -> DataFrame:
    """The words of the rows' ``text`` (without ``stop_words``), a row for each block of texts:
    ``labels``; ``lengths``, ``places`` and ``counts`` of ``counted_batches`` as bytes; ``words``,
    with the times each comes in the block (``times``) and the texts that have it (``texts``)."""
    spark = rows.sparkSession
    ship(spark)
    ranges, left_out = word_ranges(spark), dict.fromkeys(stop_words, -1)
    types = {
        "labels": pa.list_(pa.string()), "lengths": pa.binary(), "places": pa.binary(), "counts": pa.binary(),
        "words": pa.list_(pa.string()), "times": pa.list_(pa.int64()), "texts": pa.list_(pa.int64()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter(ranges)
        for batch in batches:
            labels, at = batch.column(1), 0
            texts = (text.as_py() for text in batch.column(0))
            for length, place, count, words in counted_batches(texts, words_of, left_out, True):
                values = [
                    labels.slice(at, len(length)).to_pylist(),
                    length.tobytes(),
                    _bytes(place),
                    _bytes(count),
                    words,
                    np.bincount(place, count, len(words)).astype(np.int64),
                    np.bincount(place, minlength=len(words)),
                ]
                at += len(length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(values, types.values())], names=list(types)
                )

    return rows.select("text", "label").mapInArrow(
        run,
        "labels array<string>, lengths binary, places binary, counts binary, words array<string>, "
        "times array<bigint>, texts array<bigint>",
    )


def totals(blocks: DataFrame) -> DataFrame:
    """word, times, texts: each word of ``counted`` with its sums over all blocks."""
    each = blocks.select(F.inline(F.arrays_zip("words", "times", "texts")))
    return each.groupBy(F.col("words").alias("word")).agg(
        F.sum("times").alias("times"), F.sum("texts").alias("texts")
    )


def packed(blocks: DataFrame, vocabulary: list[str], labels: list[str]) -> DataFrame:
    """The blocks of ``counted`` with places in ``vocabulary`` and ``labels``, other words left out:
    labels, lengths, places, values (binary), for ``softmax.fit_blocks`` with ``unpacked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = pa.array(labels, pa.string()), pa.array(vocabulary, pa.string())
        for batch in batches:
            for at in range(batch.num_rows):
                lengths, places, counts = (c[at].as_py() for c in batch.columns[:3])
                own, words = (c[at].values for c in batch.columns[3:])
                length = np.frombuffer(lengths, np.int32)
                n = int(length.sum())
                moved = pc.index_in(words, known).fill_null(-1).to_numpy()
                place = moved.take(_numbers(places, n)) if n else np.zeros(0, np.int32)
                kept = place >= 0
                before, ends = np.concatenate([[0], np.cumsum(kept)]), np.cumsum(length)
                parts = [
                    pc.index_in(own, classes).to_numpy().tobytes(),
                    (before[ends] - before[ends - length]).astype(np.int32).tobytes(),
                    _bytes(place[kept]),
                    _bytes(_numbers(counts, n)[kept]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.binary()) for part in parts],
                    names=["labels", "lengths", "places", "values"],
                )

    return blocks.select("lengths", "places", "counts", "labels", "words").mapInArrow(
        run, "labels binary, lengths binary, places binary, values binary"
    )


def weighted(length: np.ndarray, place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the words of some texts, each text scaled to length 1."""
    value = count * idf.take(place)
    some = np.flatnonzero(length)
    if len(some):
        norm = np.zeros(len(length))
        norm[some] = np.sqrt(np.add.reduceat(value * value, (np.cumsum(length) - length)[some]))
        norm[norm == 0] = 1
        value /= np.repeat(norm, length)
    return value


def unpacked(idf: np.ndarray) -> Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The function from a row of ``packed`` to labels, lengths, places and weighted values."""

    def read(labels: bytes, lengths: bytes, places: bytes, counts: bytes):
        label, length = (np.frombuffer(b, np.int32) for b in (labels, lengths))
        n = int(length.sum())
        place = _numbers(places, n).astype(np.intp)
        return label, length, place, weighted(length, place, _numbers(counts, n), idf)

    return read


def scorer(
    spark: SparkSession, stop_words: list[str], vocabulary: list[str], idf: np.ndarray,
    weights: np.ndarray, bias: np.ndarray, labels: list[str],
) -> Callable[[Column], Column]:
    """The function from a column of texts to (label, confidence), by a classifier's parameters."""
    ship(spark)
    ranges = word_ranges(spark)
    places = {word: at for at, word in enumerate(vocabulary)} | dict.fromkeys(stop_words, -1)
    names, weights = np.array(labels, object), np.ascontiguousarray(weights)

    def run(texts: pa.Array) -> pa.Array:
        best, sure = [], []
        for length, place, count, _ in counted_batches(
            (text.as_py() for text in texts), splitter(ranges), places, False
        ):
            place = place.astype(np.intp)
            value = weighted(length, place, count, idf)
            for of, rows in softmax.cut(length, len(bias)):
                _, share = softmax.shares(length[rows], place[of], value[of], weights, bias)
                best.append(share.argmax(axis=1))
                sure.append(share.max(axis=1))
        label = pa.array(names[np.concatenate([[], *best]).astype(int)], pa.string())
        return pa.StructArray.from_arrays([label, pa.array(np.concatenate([[], *sure]))], ["label", "confidence"])

    return F.arrow_udf(run, "label string, confidence double")
