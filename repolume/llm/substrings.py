"""Substring dedup by suffix trees that are split by prefixes.

A repeated window of WINDOW words is a node of that depth in the suffix tree of all texts.
The tree is never built whole. Each window has an anchor: of its runs of ANCHOR words the
one with the smallest hash, which equal windows share. Suffixes are dealt out by the prefix
at their anchor; consecutive windows with one anchor travel together, each as a 64-bit hash
of its words. Prefixes are of variable length: an anchor that would fill a good part of a
group (a line that many texts hold) is extended to the whole WINDOW words, which spreads its
suffixes over all groups. Groups are sized to fit a task's memory.

A task sorts the suffixes of its group by their first WINDOW words: each run of equal ones
is a deep internal node, and all of its leaves but the earliest repeat it. Suffixes are
equal if the hashes of the window (64 bits) and of the anchor (32 bits) and its place agree.
Neighbouring repeated windows of a text join to its maximal repeats.

Before anything is sent, the same is done within each run of rows that a task reads (there,
word by word), so of many copies only one for each run travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import map_arrow, worker_state, written
from repolume.llm.hashing import WordHashes, ahead, arrays_of, blob_of, mix, pieces, prefix_hashes

WINDOW = 20
ANCHOR = 3
RUN_WORDS = 1_500_000  # words that a task works on at once
GROUP_WORDS = 1_000_000  # words of the input for each group
COUNTED = 16  # anchors with fewer windows in a run of rows are not counted as frequent
NULL_ID = (1 << 63) - 1  # a null id comes after all others


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of ``width`` values from each place on."""
    best, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        later, at = ahead(best, step), np.minimum(ahead(place, step), len(values) - 1)
        at[len(values) - min(step, len(values)) :] = len(values) - 1
        later[len(values) - min(step, len(values)) :] = best[-1]
        smaller = later < best
        best, place = np.where(smaller, later, best), np.where(smaller, at, place)
        size += step
    return place


def repeats(prefix: np.ndarray, where: tuple, agree) -> np.ndarray:
    """Of suffixes, in their order of precedence, which repeat an earlier one. ``where`` has
    their identity (copies of one row are not repeats); ``agree(leaf, head)`` tells whether
    suffixes of one prefix hash are the same."""
    order = np.argsort(prefix, kind="stable")
    ordered = prefix[order]
    fresh = np.ones(len(prefix), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(prefix)), 0))]
    later = np.flatnonzero(~fresh)
    leaf, head = order[later], first[later]
    same_place = np.ones(len(leaf), bool)
    for part in where:
        same_place &= part[leaf] == part[head]
    out = np.zeros(len(prefix), bool)
    out[leaf[agree(leaf, head) & ~same_place]] = True
    return out


def _runs(flags: np.ndarray, places: np.ndarray, owner: np.ndarray) -> tuple:
    """First and last index of runs of flagged, neighbouring places of one owner."""
    chosen = np.flatnonzero(flags)
    if not len(chosen):
        return chosen, chosen
    cut = np.ones(len(chosen), bool)
    cut[1:] = (np.diff(places[chosen]) != 1) | (owner[chosen][1:] != owner[chosen][:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(chosen)) - 1
    return chosen[first], chosen[last]


class Run:
    """Texts of neighbouring rows, in order of precedence, as one array of word hashes."""

    def __init__(self, texts: list, window: int):
        texts = sorted(texts, key=lambda t: t[:2])
        self.window = window
        self.ids = np.array([t[0] for t in texts], np.int64)
        self.hashes = np.array([t[1] for t in texts], np.int64)
        self.words = np.concatenate([t[2] for t in texts])
        size = np.array([len(t[2]) for t in texts])
        self.owner = np.repeat(np.arange(len(texts)), size)
        self.start = np.arange(len(self.words)) - np.repeat(np.cumsum(size) - size, size)
        self.at = np.flatnonzero(self.start + window <= size[self.owner])
        # anchors: runs of words that lie inside the window
        self.grams = prefix_hashes(self.words, ANCHOR)
        self.place = first_minimum(self.grams, window - ANCHOR + 1)[self.at]

    def _cut(self, at: np.ndarray, place: np.ndarray, alone: np.ndarray) -> np.ndarray:
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) != 1) | (place[1:] != place[:-1]) | alone[1:] | alone[:-1]
        return np.flatnonzero(cut)

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        anchors, count = np.unique(self.grams[self.place], return_counts=True)
        return anchors[count >= COUNTED], count[count >= COUNTED]

    def blobs(self, groups: int, long_prefix: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(group, segments), and (-1 - group, repeats found within the run)."""
        if not len(self.at):
            return
        at, window = self.at, self.window
        same_row = np.cumsum(
            np.append(0, (np.diff(self.ids) != 0) | (np.diff(self.hashes) != 0))
        )
        owner = self.owner[at]
        prefix = prefix_hashes(self.words, window)

        def agree(leaf: np.ndarray, head: np.ndarray) -> np.ndarray:
            same = np.ones(len(leaf), bool)
            for offset in range(window):
                same &= self.words[at[leaf] + offset] == self.words[at[head] + offset]
            return same

        repeated = repeats(prefix[at], (same_row[owner], self.start[at]), agree)
        first, last = _runs(repeated, at, owner)
        if len(first):
            yield (
                -1 - int(self.hashes[owner[first[0]]]) % groups,
                blob_of(
                    self.ids[owner[first]], self.hashes[owner[first]],
                    self.start[at[first]], self.start[at[last]] + window,
                ),
            )
        at, place = at[~repeated], self.place[~repeated]
        if not len(at):
            return
        anchor = self.grams[place]
        found = np.minimum(np.searchsorted(long_prefix, anchor), max(0, len(long_prefix) - 1))
        alone = long_prefix[found] == anchor if len(long_prefix) else np.zeros(len(at), bool)
        first = self._cut(at, place, alone)
        many = np.diff(np.append(first, len(at)))
        dealt_by = np.where(alone, prefix[at], anchor)[first]
        group = (mix(dealt_by, dealt_by) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first, many, group = first[order], many[order], group[order]
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(group))):
            begin = at[first[a:b]]
            own = self.owner[begin]
            yield (
                int(group[a]),
                blob_of(
                    self.ids[own],
                    self.hashes[own].astype(np.int32),
                    self.start[begin].astype(np.int32),
                    many[a:b].astype(np.uint8),
                    (place[first[a:b]] - begin).astype(np.uint8),
                    (anchor[first[a:b]] >> np.uint64(32)).astype(np.uint32),
                    prefix[pieces(begin, many[a:b])],
                ),
            )


def subtree(blobs: list[list[np.ndarray]], window: int) -> tuple[np.ndarray, ...]:
    """Repeats (id, text hash, first word, end) of one group's suffixes."""
    ids, hashes, start, many, offset, anchor, prefix = (
        np.concatenate([b[i] for b in blobs]) for i in range(7)
    )
    many = many.astype(np.int64)
    begin = np.cumsum(many) - many
    order = np.lexsort((start, hashes, ids))  # smaller ids first, then earlier words
    prefix = prefix[pieces(begin[order], many[order])]
    ids, hashes, start, many = ids[order], hashes[order], start[order].astype(np.int64), many[order]
    offset, anchor = offset[order].astype(np.int64), anchor[order]
    owner = np.repeat(np.arange(len(many)), many)
    inner = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    starts = start[owner] + inner
    to_anchor = offset[owner] - inner

    def agree(leaf: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (anchor[owner[leaf]] == anchor[owner[head]]) & (to_anchor[leaf] == to_anchor[head])

    repeated = repeats(prefix, (ids[owner], hashes[owner], starts), agree)
    first, last = _runs(repeated, starts, owner)
    return ids[owner[first]], hashes[owner[first]], starts[first], starts[last] + window


KEY = ["doc_id", "text_hash"]


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id",
        # tells rows of equal id apart; 31 bits travel in four bytes
        F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )


def _texts(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[Run]:
    hashes = worker_state("substring-words", WordHashes)
    texts, held = [], 0
    for batch in batches:
        for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = hashes.of(text)
            if len(words) < window:
                continue
            texts.append((NULL_ID if doc_id is None else doc_id, text_hash, words))
            held += len(words)
            if held >= most:
                yield Run(texts, window)
                texts, held = [], 0
    if texts:
        yield Run(texts, window)


def frequent_anchors(keyed: DataFrame, window: int, group_words: int) -> tuple[int, np.ndarray]:
    """Number of groups, and the anchors with over a quarter of a group's share of windows:
    at most four for each group, as there are not more windows."""

    run_words = RUN_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches, window, run_words):
            anchors, count = part.frequent()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *anchors.astype(np.int64).tolist()], pa.int64()),
                    pa.array([len(part.at), *count.tolist()], pa.int64()),
                ],
                names=["anchor", "n"],
            )

    spark = keyed.sparkSession
    counts = written(
        spark,
        map_arrow(keyed, run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")),
        "anchor-counts",
    )
    total = counts.where("anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_words))
    limit = max(1000, total // groups // 4)
    rows = counts.where((F.col("n") > limit) & F.col("anchor").isNotNull()).collect()
    return groups, np.sort(np.array([r.anchor for r in rows], np.int64).astype(np.uint64))


def repeated_spans(
    documents: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS
) -> DataFrame:
    """doc_id, text_hash, begin, end: words covered by a window whose words also start
    earlier (a smaller id, or earlier in the same text). Spans of one text may overlap."""
    keyed = _keyed(documents)
    groups, long_prefix = frequent_anchors(keyed, window, group_words)
    run_words = RUN_WORDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches, window, run_words):
            for group, blob in part.blobs(groups, long_prefix):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.int64()), pa.array([blob], pa.binary())],
                    names=["part", "blob"],
                )

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [arrays_of(b) for b in table.column("blob").to_pylist()]
        if key[0].as_py() < 0:  # already solved within a run of rows
            out = [np.concatenate([b[i] for b in blobs]) for i in range(4)]
        else:
            out = subtree(blobs, window)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=[*KEY, "begin", "end"])

    dealt = map_arrow(keyed, deal, "part long, blob binary")
    found = dealt.groupBy("part").applyInArrow(
        solve, "doc_id long, text_hash long, begin long, end long"
    )
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space) for every row.

    Null and empty texts, and texts of fewer than ``window`` words, lose nothing. Rows of
    equal id and text are one document and get one result. Rows of equal id and other text
    are other documents, ordered by a hash of the text; null ids come last. Only ``doc_id``
    and ``text`` are read; other columns may have any name.
    """
    spans = repeated_spans(documents, window)
    spans = spans.groupBy(*KEY).agg(
        F.collect_list(F.struct("begin", "end")).alias("spans")
    )  # as many as a text has words at most
    spans = spans.withColumnsRenamed({k: f"r_{k}" for k in KEY})
    keyed = _keyed(documents)
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEY]
    joined = keyed.join(spans, on[0] & on[1], "left").select(
        "doc_id", "text", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, begin, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.split()
                total.append(len(words))
                if begin:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, end, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array([k.decode() for k in kept], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return map_arrow(
        joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
