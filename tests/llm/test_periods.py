"""Periodic runs: the stream of catchers and the operator against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from repolume.llm import periods, queries
from tests.llm.helpers import ODD_TEXTS, WORD, documents


def by_hand(words, least=24, times=3):
    """Runs by definition: maximal stretches with their smallest period."""
    out = set()
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                stretch = words[i : i + length]
                if not any(
                    all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)
                ):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def planted(seed, count, alphabet):
    rng = random.Random(seed)
    words = []
    while len(words) < count:
        if rng.random() < 0.4:
            part = [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 17))]
            words += part * rng.randint(2, 9) + part[: rng.randrange(len(part))]
        else:
            words += [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 30))]
    return words


def numbers(words):
    return np.array([int(hashlib.sha256(w.encode()).hexdigest()[:15], 16) for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_stream_in_pieces(seed, step):
    words = planted(seed, 300, (2, 3, 50)[seed % 3])
    for least, times in ((24, 3), (6, 2), (4, 2)):
        stream = periods.Squares(least, times)
        flat = numbers(words)
        for a in range(0, len(flat), step):
            stream.append(flat[a : a + step])
        assert stream.runs() == by_hand(words, least, times)


def test_stream_tells_runs_so_far():
    words = ["a", "b"] * 20 + ["c"] + ["d"] * 30
    flat, stream = numbers(words), periods.Squares()
    for i in range(len(flat)):
        stream.append(flat[i : i + 1])
        assert stream.runs() == by_hand(words[: i + 1])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 15, 31, 64, 100])
def test_every_period(size):
    rng = random.Random(size)
    part = [str(rng.random()) for _ in range(size)]
    for before in (0, 1, 5):
        words = ["x"] * before + part * 3 + part[: size // 2] + ["end"]
        stream = periods.Squares(3, 3, len(words) // 3)
        stream.append(numbers(words))
        assert stream.runs() == by_hand(words, 3, 3)


def test_plain_search_equals_definition():
    for seed in range(6):
        words = planted(seed, 200, 3)
        assert periods.by_words(words, 6, 2) == by_hand(words, 6, 2)


def test_words_of_one_hash(monkeypatch):
    """Where hashes can't tell words apart, words do."""

    class Same(dict):
        def __missing__(self, word):
            return len(word)

    texts = [planted(s, 150, 4) for s in range(3)] + [["a"] * 15 + ["b"] * 15]
    texts = [[w.encode() for w in words] for words in texts]
    assert periods.runs_of_texts(texts, 6, 3, Same()) == [by_hand(t, 6, 3) for t in texts]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(spark, rows, **limits):
    got = periods.periodic_runs(documents(spark, rows, clashing=True), **limits).collect()
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = by_hand(words, **limits)
        want.append((doc_id, len(words), tuple(runs), collapsed(words, runs)))
    plain = [(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    return got


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(periods, "STREAM_WORDS", 900)
    rows = [(i, " ".join(planted(i, 40 * (i % 9), 2 + i % 5))) for i in range(60)]
    rows += [(None, "a b " * 20), (None, "a b " * 20), (7, "x  y\n" * 30), (8, None), (9, "")]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    assert sum(len(r.runs) for r in check(spark, rows)) > 50
    check(spark, rows, least=4, times=2)


def test_very_long_text_and_many_empty_ones(spark):
    part = [str(i) for i in range(1500)]
    long = ["same"] * 30_000 + part * 4 + ["end"] + ["p", "q", "r"] * 9
    rows = [(1, " ".join(long))] + [(2, "")] * 3000 + [(3, None)] * 3000
    got = periods.periodic_runs(documents(spark, rows, partitions=1)).collect()
    assert len(got) == len(rows)
    (one,) = [r for r in got if r.doc_id == 1]
    assert [tuple(r) for r in one.runs] == [
        (0, 30_000, 1), (30_000, 6000, 1500), (36_001, 27, 3)
    ]
    assert one.collapsed == " ".join(["same", *part, "end", "p", "q", "r"])
    assert all(not r.runs and r.collapsed == "" for r in got if r.doc_id != 1)


def test_empty_table(spark):
    assert periods.periodic_runs(documents(spark, [])).collect() == []


def planted_by_hand(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, tmp_path):
    rows = [(i, " ".join(planted(i, 60 + i, 400))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (-5, " lead and  gaps \t" * 9)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periods(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = planted_by_hand(doc_id, text)
        runs = by_hand(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        assert tuple(got[doc_id]) == (
            doc_id,
            len(runs),
            *best,
            milli,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        )
    assert sum(r.n_runs > 0 for r in got.values()) > 10
