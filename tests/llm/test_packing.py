"""Packing: an exact round trip, capacity, padding and balance."""

import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from repolume.llm import packing, queries
from tests.llm.helpers import ODD_TEXTS, documents, prose


def tokens(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(rows, pieces):
    """Every id of every document lies in one piece; sequences are gapless and bounded."""
    wanted = collections.Counter()
    for doc_id, text in rows:
        wanted[doc_id, tuple(tokens(text))] += 1
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, parts in by_doc.items():
        ids = [n for p in parts for n in np.frombuffer(p.ids, "<u4").tolist()]
        expected = [n for (d, t), k in wanted.items() if d == doc_id for n in t * k]
        assert collections.Counter(ids) == collections.Counter(expected)
        if sum(k for (d, _), k in wanted.items() if d == doc_id) == 1:
            parts.sort(key=lambda p: p.start)
            assert [p.start for p in parts] == np.cumsum(
                [0] + [p.length for p in parts[:-1]]
            ).tolist()
            assert [n for p in parts for n in np.frombuffer(p.ids, "<u4").tolist()] == expected
            assert {p.doc_tokens for p in parts} == {len(expected)}
    assert set(by_doc) == {d for d, _ in rows}
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        sequences[p.sequence_id].append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts[:-1]]).tolist()
        assert sum(p.length for p in parts) <= packing.LENGTH
    return sequences


def test_round_trip_of_odd_texts(spark):
    rows = list(enumerate(ODD_TEXTS)) + [
        (50, "x" * 9000),
        (51, " ".join(prose(1, 5000))),
        (52, "don't 'S it's <|endoftext|> a <|startoftext|>b, TÉST ... A.B.C x!!! 12ab"),
        (53, "Á é ΑΣ Σ. İ ﬁ ẞ ​​x y\x1cz"),
        (54, " ".join(f"w{i}!!" for i in range(50))),
        (54, "same id, other text"),
        (7, "repeated row"),
        (7, "repeated row"),
        (None, "no id"),
    ]
    pieces = packing.pack(documents(spark, rows, clashing=True)).collect()
    check(rows, pieces)


def test_little_padding_and_balance(spark):
    rows = [(i, " ".join(prose(i, 50 + 37 * i % 900))) for i in range(300)]
    pieces = packing.pack(documents(spark, rows, partitions=1)).collect()
    sequences = check(rows, pieces)
    fill = [sum(p.length for p in s) for s in sequences.values()]
    assert len(fill) == -(-sum(fill) // packing.LENGTH)


def test_balanced_places_by_cost():
    # one long and two short pieces in two sequences: the short ones share the cheaper one
    assert packing.balanced([10, 4, 4], 12) == [[(0, 0, 10)], [(1, 0, 4), (2, 0, 4)]]
    # ties go by order, and what fits nowhere is cut
    assert packing.balanced([6, 6, 6], 9) == [[(0, 0, 6), (2, 0, 3)], [(1, 0, 6), (2, 3, 6)]]
    assert packing.balanced([], 9) == [] and packing.balanced([0, 0], 9) == []


def test_costs_are_closer_than_by_order_of_arrival():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 400).tolist()

    def cost(n):
        return packing.LINEAR * n + packing.QUADRATIC * n * n

    own = [sum(cost(b - a) for _, a, b in s) for s in packing.balanced(lengths, 2048)]
    first_fit, held = [[]], 0
    for n in lengths:
        if held + n > 2048:
            first_fit.append([])
            held = 0
        first_fit[-1].append(n)
        held += n
    naive = [sum(map(cost, s)) for s in first_fit]
    assert np.std(own) / np.mean(own) < np.std(naive) / np.mean(naive)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_query_digests(spark):
    found = queries.op1_pack(spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {r.doc_id: tokens(r.text) for r in texts}
    rows = found.collect()
    assert found.columns[:7] == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
