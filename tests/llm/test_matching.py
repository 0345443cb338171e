"""Prediction by partial matching: each byte and each text against plain Python."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolume.llm import matching, queries
from tests.llm.helpers import ODD_TEXTS, WORD, documents, prose


def lower(text):
    return (text or "").encode().lower()


class Model:
    """Counts of each context's next bytes, and the probability of one byte, by definition."""

    def __init__(self, texts, order):
        self.order = order
        self.next = collections.defaultdict(collections.Counter)
        for text in texts:
            data = bytes(order) + text + bytes([matching.END])
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.next[data[i - k : i]][data[i]] += 1

    def probability(self, context, byte):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.next.get(context[len(context) - k :])
            if not counts:
                continue
            left = {b: c for b, c in counts.items() if b not in excluded}
            if left:
                whole = sum(left.values()) + len(left)
                if byte in left:
                    return p * left[byte] / whole
                p *= len(left) / whole
            excluded |= set(counts)
        return p / max(1, 256 - len(excluded))

    def log(self, text):
        data = bytes(self.order) + text + bytes([matching.END])
        return math.fsum(
            math.log10(self.probability(data[i - self.order : i], data[i]))
            for i in range(self.order, len(data))
        )


@pytest.mark.parametrize("order", [1, 2, 4, 6])
def test_probabilities_of_grams(order):
    texts = [b"abracadabra", b"abra cadabra \xc3\xa9\xc3\xa9", b"", b"zzz" * 9]
    asked = texts + [b"barbara \xff\x00", b"qqq abra"]
    model = Model(texts, order)

    def codes(texts):
        parts = [bytes(order) + t + bytes([matching.END]) for t in texts]
        return matching.grams_of(
            np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), order
        )

    learnt = collections.Counter(codes(texts).tolist())
    grams = np.unique(codes(asked + texts))
    counts = np.array([learnt[g] for g in grams.tolist()])
    low = np.zeros((256, 256), np.int64)
    for gram, n in learnt.items():
        low[gram >> 8 & 255, gram & 255] += n
    got = matching.log_probabilities(grams, counts, low, order)
    for gram, value in zip(grams.tolist(), got.tolist()):
        data = gram.to_bytes(order + 1, "big")
        assert value == pytest.approx(math.log10(model.probability(data[:-1], data[-1])), abs=1e-9)


def test_probabilities_sum_to_one():
    texts = [" ".join(prose(s, 40)).encode() for s in range(3)]
    model = Model(texts, 3)
    for context in (bytes(3), b"a b", b"xyz", b"e t"):
        total = math.fsum(model.probability(context, b) for b in range(256))
        assert total == pytest.approx(1)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def by_hand(rows, order=matching.ORDER):
    train = [lower(t) for d, t in rows if not held(d)]
    model = Model(train, order)
    count = collections.Counter()
    for text in train:
        count.update(text.split())
        count["end"] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for doc_id, text in rows:
        words = [*(w.encode() for w in WORD.findall(lower(text).decode())), "end"]
        base = math.fsum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        known = sum(count[w] > 0 for w in words)
        out.append((doc_id, held(doc_id), len(words), known, n, base, model.log(lower(text))))
    return out


def check(got, want):
    def key(row):
        return (repr(row[0]), row[2], round(row[6], 6))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], abs=1e-7)


def scored(spark, rows, order=matching.ORDER, **kw):
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return matching.text_scores(documents(spark, rows, **kw), out, order).collect()


def texts(seed, count):
    rng = random.Random(seed)
    return [
        (i, " ".join(prose(rng.randrange(count), rng.randrange(40))).title()) for i in range(count)
    ]


@pytest.mark.parametrize("order", [2, 4])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(matching, "RUN_BYTES", 900)
    monkeypatch.setattr(matching, "SCORED_BYTES", 300)
    rows = texts(1, 60) + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id"), (5, "twice"), (5, "twice"), (200, None), (201, "")]
    got = scored(spark, rows, order, clashing=True)
    check(got, by_hand(rows, order))
    assert {r.held_out for r in got} == {True, False}


def test_very_long_text_is_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(matching, "RUN_BYTES", 500)
    long = " ".join(prose(9, 1500)) + "\n" + "x" * 3000 + " end of it"
    rows = texts(2, 12) + [(50, long), (51, long.upper())]
    check(scored(spark, rows), by_hand(rows))


def test_nothing_learnt_and_empty_table(spark):
    ids = [i for i in range(200) if held(i)][:4]
    rows = [(i, "some text") for i in ids]
    got = scored(spark, rows)
    check(got, by_hand(rows))
    assert {(r.train_tokens, r.base_score) for r in got} == {(0, 0.0)}
    assert scored(spark, []) == []


def test_order_is_checked(spark):
    with pytest.raises(ValueError):
        scored(spark, [(1, "x")], 7)


def test_query_tells_likely_texts(spark, tmp_path):
    """Held-out texts of the learnt kind are likelier than the same words' letters shuffled."""
    rows = texts(4, 150)
    shuffled = []
    rng = random.Random(4)
    for i, text in rows:
        if held(i) and text:
            letters = list(text)
            rng.shuffle(letters)
            shuffled.append((i, "".join(letters)))
    scores = {}
    for name, extra in (("plain", []), ("shuffled", shuffled)):
        new = dict(extra)
        documents(spark, [(i, new.get(i, t)) for i, t in rows]).write.parquet(
            f"{tmp_path}/{name}/documents.parquet"
        )
        result = queries.op13_matching(spark, f"{tmp_path}/{name}").collect()
        scores[name] = {r.doc_id: r.score for r in result}
    assert shuffled
    assert all(scores["plain"][i] > scores["shuffled"][i] for i, _ in shuffled)
