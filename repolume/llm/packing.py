"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays within a piece).
Documents are cut into full sequences and a rest. The rests of one block (a run of rows of
one partition, bounded in tokens) go, in order of falling cost, to the cheapest sequence
that has room for them. As many sequences are opened as the tokens of the block need; a
rest that fits into none is cut over those with room, so a block wastes less than one
sequence in all. Nothing is shuffled: a block sees rows of one input partition, whatever
their key or source.

A word's tokens do not depend on its neighbours, as the vocabulary's pre-tokenizer never
crosses white space; so each distinct word is encoded once for each worker. The words of some
megabytes of texts are numbered by Arrow, and only distinct ones are looked up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import in_pieces, map_arrow, worker_state

VOCABULARY = "word_bpe_49k.json"
END_ID = 1  # closes each document
LENGTH = 2048
BLOCK_TOKENS = 2048 * 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 512
KEPT_WORDS = 200_000
PLAIN_MARKS = "!#$%&*,.:;?|"
PART_BYTES = 4 << 20  # texts encoded together, or one longer text
RUN_WORDS, RUNS = 500, 20  # words encoded as one text, and such texts at once

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
    "offset long, ids binary"
)


class WordTokens:
    """Ids of each distinct word met so far, as little-endian unsigned 32-bit numbers.

    Of the words known, those that were not met again while as many others were learnt go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([name.endswith("</w>") for name in names])
        probe = self.tokenizer.encode("some words", add_special_tokens=False).ids
        if self.ends[probe].sum() != 2:
            raise ValueError(f"{path}: its pieces do not mark the ends of words by </w>")
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn_letters(self, words: list[bytes]) -> None:
        """Runs of letters are encoded many at a time, parted by spaces: each is one run of the
        pre-tokenizer, and ends in the only piece of it that marks an end. The few letters
        whose small form is more than one letter part a run; then each word is encoded alone."""
        many = [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
        texts = [b" ".join(part).decode() for part in many]
        found = (self._ids(texts[i : i + RUNS]) for i in range(0, len(texts), RUNS))
        for part, ids in zip(many, itertools.chain.from_iterable(found)):
            data = ids.tobytes()
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                self.known.update(zip(part, map(data.__getitem__, map(slice, [0] + ends, ends))))
            else:
                self._learn_others(part, self.known)

    def _learn_others(self, words: list[bytes], known: dict[bytes, bytes]) -> None:
        for at in range(0, len(words), RUN_WORDS * RUNS):
            part = words[at : at + RUN_WORDS * RUNS]
            known.update(zip(part, (i.tobytes() for i in self._ids([w.decode() for w in part]))))

    def _learn(self, stems: list[bytes], letters: list[bool]) -> None:
        """Learn those that are not known; ``letters``: whether they are letters only."""
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.before, self.marks = {}, self.known, {}
        known, before = self.known, self.before
        runs, others = [], []
        for stem, is_run in zip(stems, letters):
            if stem not in known:
                if stem in before:
                    known[stem] = before[stem]
                else:
                    (runs if is_run else others).append(stem)
        self._learn_letters(runs)
        self._learn_others(others, known)

    def encode(self, texts: pa.Array | list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text, given in UTF-8."""
        texts = _plain(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = int(sizes[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + PART_BYTES, "right")))
            yield from self._encode_part(texts[begin:end])
            begin = end

    def _encode_part(self, texts: pa.Array) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(texts)
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        found = words.flatten().dictionary_encode()
        # A run of letters and a run of other marks after it are parted by the
        # pre-tokenizer, so a word is its letters, then its marks; others are whole.
        whole = found.dictionary
        stems = pc.ascii_rtrim(whole, characters=PLAIN_MARKS)
        parted = pc.utf8_is_alpha(stems)
        stems = pc.if_else(parted, stems, whole).dictionary_encode()
        at_stem = stems.indices.to_numpy()
        distinct = _bytes(stems.dictionary)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))[at_stem].tolist()
        marks = [word[size:] for word, size in zip(_bytes(whole), sizes)]
        is_run = pc.utf8_is_alpha(stems.dictionary).to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct, is_run)
        self._learn_others(list(set(marks).difference(self.marks)), self.marks)

        known = [self.known[stem] for stem in distinct]
        of_stem = map(known.__getitem__, at_stem.tolist())
        ids = [stem + self.marks[mark] for stem, mark in zip(of_stem, marks)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        data = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(lengths) - lengths

        at = found.indices.to_numpy()
        each = lengths[at]
        last = np.cumsum(each)
        place = np.arange(last[-1] if len(last) else 0) + np.repeat(first[at] - last + each, each)
        tokens = data[place]
        last = np.concatenate([[0], last])
        begin = 0
        for end in ends.tolist():
            yield tokens[last[begin] : last[end]].tobytes()
            begin = end


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _plain(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, as the vocabulary has them; not where that could make a name of a
    special token. A null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.string(), safe=False), "")
    return pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))


def balanced(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (piece, from, to): pieces in order of falling cost, each to
    the cheapest sequence with room; what has no room anywhere is cut over those with room.
    Equal costs go by the order of pieces and sequences."""
    total = sum(lengths)
    many = -(-total // capacity)
    if not many:
        return []
    sequences: list = [[] for _ in range(many)]
    cost, room = np.zeros(many), np.full(many, capacity, np.int64)

    def put(to: int, piece: int, begin: int, end: int) -> None:
        size = end - begin
        sequences[to].append((piece, begin, end))
        cost[to] += LINEAR * size + QUADRATIC * size * size
        room[to] -= size

    without = []
    for piece in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = lengths[piece]
        if not size:
            continue
        to = int(np.where(room >= size, cost, np.inf).argmin())
        if room[to] >= size:
            put(to, piece, 0, size)
        else:
            without.append(piece)
    for piece in without:
        begin = 0
        while begin < lengths[piece]:
            to = int(room.argmax())
            end = min(lengths[piece], begin + int(room[to]))
            put(to, piece, begin, end)
            begin = end
    return [s for s in sequences if s]


def pack(documents: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start (tokens of the document before it), length,
    doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    Each document ends in the id ``END_ID``; a null or empty text is that id alone. Repeated
    rows and null ids are documents of their own. Very long texts are cut into full sequences.
    Only ``doc_id`` and ``text`` are read; other columns may have any name.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    closing = np.array([END_ID], "<u4").tobytes()

    def rows(first: int, block: list) -> tuple[list, int]:
        """Rows of a block [(doc_id, ids)], and the next sequence id."""
        out, rests, sequence = [], [], first
        for doc_id, ids in block:
            count = len(ids) // 4
            for start in range(0, count - length + 1, length):
                out.append((doc_id, start, length, count, sequence, 0, ids))
                sequence += 1
            rests.append((doc_id, count - count % length, count, ids))
        for pieces in balanced([n - start for _, start, n, _ in rests], length):
            offset = 0
            for piece, begin, end in pieces:
                doc_id, start, count, ids = rests[piece]
                out.append((doc_id, start + begin, end - begin, count, sequence, offset, ids))
                offset += end - begin
            sequence += 1
        return out, sequence

    def batch_of(out: list) -> pa.RecordBatch:
        *plain, ids = zip(*out)
        cut = [
            i[4 * start : 4 * (start + size)] for i, start, size in zip(ids, plain[1], plain[2])
        ]
        arrays = [pa.array(c, pa.int64()) for c in plain] + [pa.array(cut, pa.binary())]
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_state(path, lambda: WordTokens(path))
        sequence = TaskContext.get().partitionId() << 40
        block, held = [], 0
        for batch in in_pieces(batches, PART_BYTES):
            ids = tokens.encode(batch.column(1))
            for doc_id, found in zip(batch.column(0).to_pylist(), ids):
                block.append((doc_id, found + closing))
                held += len(found) // 4 + 1
                if held >= BLOCK_TOKENS:
                    out, sequence = rows(sequence, block)
                    for at in range(0, len(out), 2000):
                        yield batch_of(out[at : at + 2000])
                    block, held = [], 0
        if block:
            out, sequence = rows(sequence, block)
            for at in range(0, len(out), 2000):
                yield batch_of(out[at : at + 2000])

    texts = documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")
    )
    return map_arrow(texts, run, PIECES)
