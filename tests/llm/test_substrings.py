"""Substring dedup against a scan of all windows in order."""

import random

import numpy as np
import pytest

from repolume.llm import hashing, queries, substrings
from tests.llm.helpers import ODD_TEXTS, documents, prose, sha, without_repeats


def rows_with_repeats(seed):
    rng = random.Random(seed)
    passages = [prose(seed * 10 + i, n) for i, n in enumerate((19, 20, 21, 55, 300))]
    line = prose(seed + 500, 6)
    texts = list(ODD_TEXTS)
    for i in range(60):
        parts = prose(seed * 1000 + i, rng.randrange(60), 3000)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(passages + [line])
        texts.append(" ".join(parts))
    texts += [" ".join(["again"] * 70), " ".join(["again"] * 19), " ".join(passages[3] * 3)]
    texts += texts[10:14]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [rows[9], (rows[5][0], "other text of that id " + texts[20]), (None, texts[30])]


def same(rows, found, names=("n_words", "n_removed", "kept")):
    wanted = without_repeats(rows)
    expected = sorted((str(rows[i][0]), *w) for i, w in wanted.items())
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in found) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scan_of_windows(spark, seed):
    rows = rows_with_repeats(seed)
    rows = [r for r in rows if not (r[1] or "").startswith("other text")]
    found = substrings.remove_repeats(documents(spark, rows, clashing=True))
    same(rows, found.collect())


def test_small_groups_and_long_prefixes(spark, monkeypatch):
    """Many runs of rows, many groups, and every anchor extended to the whole window."""
    monkeypatch.setattr(substrings, "RUN_WORDS", 300)
    monkeypatch.setattr(substrings, "COUNTED", 1)
    whole = substrings.frequent_anchors

    def all_frequent(keyed, window, group_words):
        groups, _ = whole(keyed, window, 100)
        rows = [hashing.WordHashes().of(t.text) for t in keyed.collect()]
        grams = [hashing.prefix_hashes(r, substrings.ANCHOR) for r in rows if len(r) > 3]
        return groups, np.unique(np.concatenate(grams)[::2])

    monkeypatch.setattr(substrings, "frequent_anchors", all_frequent)
    rows = [r for r in rows_with_repeats(4) if not (r[1] or "").startswith("other text")]
    same(rows, substrings.remove_repeats(documents(spark, rows)).collect())


def test_rows_of_one_id_with_other_texts(spark):
    rows = rows_with_repeats(3)
    found = substrings.remove_repeats(documents(spark, rows)).collect()
    assert len(found) == len(rows)


def test_other_windows(spark):
    text = " ".join(prose(1, 30))
    found = substrings.repeated_spans(documents(spark, [(1, text), (2, "x " + text)]), window=5)
    assert [(r.doc_id, r.begin, r.end) for r in found.collect()] == [(2, 1, 31)] or {
        i for r in found.collect() for i in range(r.begin, r.end)
    } == set(range(1, 31))


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [
        (r.doc_id, r.text)
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ]
    wanted = without_repeats(rows)
    expected = sorted((rows[i][0], n, removed, sha(kept)) for i, (n, removed, kept) in wanted.items())
    assert sorted(map(tuple, queries.op9_substrings(spark, sf_dir).collect())) == expected
