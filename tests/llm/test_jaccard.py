"""The similarity join against all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from repolume.llm import jaccard, queries
from repolume.llm.common import SWEEP, written_swept
from tests.llm.helpers import ODD_TEXTS, documents, prose, similar_components


def near_copies(seed, base, copies, changes):
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def rows_of_many_kinds(seed):
    rng = random.Random(seed)
    texts = [t for t in ODD_TEXTS] + ODD_TEXTS[3:]
    for k in range(6):
        base = prose(seed * 100 + k, rng.choice([6, 9, 20, 60, 150, 400]))
        texts += near_copies(seed + k, base, 9, max(1, len(base) // 25))
    passage = prose(seed + 77, 40)  # shared by texts that are not similar
    texts += [" ".join(passage + prose(seed * 7 + i, 60, 5000)) for i in range(25)]
    texts += ["a b c d e", "A B C D E", "a b c d e f", "a b c", "a  b\nc"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[3], (None, texts[8]), (None, None)]


def same_partition(rows, found, k, percent):
    """Whether components and their names equal those of the brute force."""
    wanted = similar_components(rows, k, percent)
    least = {}
    for (doc_id, _), (_, root) in zip(rows, wanted):
        if root is not None and doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = sorted(
        (str(doc_id), n, str(doc_id if root is None else least.get(root)))
        for (doc_id, _), (n, root) in zip(rows, wanted)
    )
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)
    assert got == expected


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_equal_all_pairs(spark, seed, k, percent):
    rows = rows_of_many_kinds(seed)
    found = jaccard.similar_documents(documents(spark, rows, clashing=True), k, percent)
    same_partition(rows, found.collect(), k, percent)


def test_small_runs_and_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_WORDS", 600)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 500)
    rows = rows_of_many_kinds(5)
    found = jaccard.similar_documents(documents(spark, rows), 4, 85)
    same_partition(rows, found.collect(), 4, 85)


def test_chain_at_the_threshold(spark):
    """Neighbours of a chain are similar and its ends are not."""
    words = prose(9, 120, 10**6)
    texts = [" ".join(words[i * 2 : i * 2 + 60]) for i in range(12)]
    rows = list(enumerate(texts))
    found = jaccard.similar_documents(documents(spark, rows), 4, 85)
    same_partition(rows, found.collect(), 4, 85)


def test_pigeonhole_has_room():
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        for a in list(range(1, 400)) + [1000, 5000]:
            for b in (a, a * 100 // percent):
                band_a, band_b = bands.of(jaccard.np.array([a, b]))
                assert band_b - band_a in (0, 1)
                differ = jaccard.most_different(a + b, percent)
                agree = bands.blocks[band_b] - differ
                least = 1 + bands.empty[band_b] + bands.shared[band_b]
                assert agree >= least or bands.most[band_b] == 0
                if bands.most[band_b] == 0:
                    assert differ == 0


def test_components_of_links(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)]
    pairs += [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert found == (
        {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {i: 500 for i in range(501, 560)}
    )


def test_empty_table(spark):
    assert jaccard.similar_documents(documents(spark, [])).count() == 0


def test_query_equals_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [
        (r.doc_id, r.text)
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ]
    same_partition(rows, queries.op4_jaccard(spark, sf_dir).collect(), 4, 85)


def test_parity_is_that_of_the_shingles():
    rng = np.random.default_rng(1)
    sets = jaccard.Sets([rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (0, 3, 40, 900)], 5)
    parity = sets.parity().view(np.uint64)
    for row in range(4):
        bits = [0] * jaccard.PARITY
        for shingle in sets.set_of(row).tolist():
            bits[(shingle >> 20) % jaccard.PARITY] ^= 1
        got = [int(parity[row, i // 64] >> np.uint64(i % 64)) & 1 for i in range(jaccard.PARITY)]
        assert got == bits


@pytest.mark.parametrize("text", [b"", b" \n", None, b"word"])
def test_many_short_texts_end_a_run(text):
    """Rows end a run as words do, so a partition of texts without words stays small."""
    count = 120_000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(count)), pa.array([0] * count), pa.array([text] * count, pa.binary())],
        names=["doc_id", "text_hash", "text"],
    )
    tracemalloc.start()
    rows = 0
    for run, sets in jaccard._texts(iter([batch]), 5, jaccard.RUN_WORDS):
        assert len(run) <= jaccard.RUN_ROWS
        assert sets.parity().shape == (len(run), jaccard.PARITY // 64)
        rows += len(run)
    assert rows == count
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_swept_tables_put_the_setting_back(spark):
    before = spark.conf.get(SWEEP, None)
    rows = spark.range(100).selectExpr("id % 7 AS k").distinct()
    assert written_swept(spark, rows, "swept").count() == 7
    assert spark.conf.get(SWEEP, None) == before
    with pytest.raises(Exception):
        written_swept(spark, rows.selectExpr("raise_error('x') AS k"), "swept").count()
    assert spark.conf.get(SWEEP, None) == before


def test_long_parity_is_no_more_than_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (1, 1), (0, 40), (512, 513), (900, 1100), (3000, 3600), (5000, 5000)):
        a, b = (rng.integers(0, 1 << 62, k).astype(np.uint64) for k in (n, m))
        b[: min(n, m) // 3] = a[: min(n, m) // 3]
        a, b = np.unique(a), np.unique(b)
        differ = len(np.setxor1d(a, b))
        bits, others = jaccard.long_parity(a), jaccard.long_parity(b)
        assert len(bits) * 8 >= max(len(a), jaccard.PARITY)
        distance = jaccard.parity_distance(bits, others)
        assert distance == jaccard.parity_distance(others, bits) <= differ
        assert jaccard.parity_distance(bits, bits) == 0
        if min(n, m) > jaccard.PARITY:  # a third of the shingles in common is never near
            assert distance > jaccard.most_different(len(a) + len(b), 80)


def test_long_texts_that_are_not_similar_are_not_sent_whole(spark, monkeypatch):
    """Texts of 3000 words that share half of them, and one near copy of each: only the copies
    have their whole sets compared."""
    shared, rows = prose(40, 1500, 10**6), []
    for i in range(12):
        own = shared + prose(50 + i, 1500, 10**6)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-40]))]
    sent, verify = [], jaccard.Join.verify

    def counted(self, pairs):
        sent.extend((r.a, r.b) for r in pairs.collect())
        return verify(self, pairs)

    monkeypatch.setattr(jaccard.Join, "verify", counted)
    found = jaccard.similar_documents(documents(spark, rows), 5, 80)
    same_partition(rows, found.collect(), 5, 80)
    assert len(sent) == len(set(sent)) == 12
