"""Language, quality, toxicity: brute force of their parts, and held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from repolume.llm import language, quality, queries, toxicity
from tests.llm.helpers import ODD_TEXTS, documents, labels, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lattice():
    return language.Lattice(language.vocabulary(public_tokenizers.path(language.VOCABULARY)))


def all_cuts(lattice, word, p):
    """Sum over all ways to cut a word, one by one."""
    marked, total = language.MARK + word, 0.0
    for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
        product = 1.0
        for a, b in itertools.pairwise(edges):
            part = marked[a:b]
            if part in lattice.pieces:
                product *= p[lattice.pieces[part]]
            elif len(part) == 1:
                product *= math.prod(p[lattice.pieces[f"<0x{x:02X}>"]] for x in part.encode())
            else:
                product = 0.0
        total += product
    return total


def test_forward_sums_all_segmentations(lattice):
    rng = np.random.default_rng(1)
    table = rng.random((32000, 3))
    table /= table.sum(axis=0)
    words = ["a", "the", "tionen", "été", "漢x", "zzzzzz", "straße"]
    got = lattice.log_probabilities(words, np.log(table))
    for word, logs in zip(words, got):
        for column in range(3):
            p = table[:, column].tolist()
            assert logs[column] == pytest.approx(math.log(all_cuts(lattice, word, p)))
            assert lattice.log_probability(word, p) == pytest.approx(logs[column])


def test_long_words_do_not_underflow(lattice):
    table = np.full((32000, 1), 1 / 32000)
    long = lattice.log_probabilities(["ab漢" * 1000], np.log(table))[0, 0]
    assert -1e6 < long < -5000


def test_expected_uses_are_derivatives(lattice):
    rng = np.random.default_rng(2)
    p = rng.random(32000)
    logs = np.log(p / p.sum())
    words, counts = ["the", "tion", "é漢"], [2, 1, 3]
    uses = lattice.expected(words, counts, logs)
    for piece in np.flatnonzero(uses)[:6]:
        moved = logs.copy()
        moved[piece] += 1e-6
        change = lattice.log_probabilities(words, np.stack([logs, moved], axis=1))
        slope = ((change[:, 1] - change[:, 0]) * counts).sum() / 1e-6
        assert uses[piece] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def two_languages(spark, clashing=False):
    rng = random.Random(5)
    kinds = {"aa": ["bala", "tiko", "nor", "satu"], "bb": ["schwig", "drucht", "pfen", "klau"]}
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(20)), lang))
    rows += [(100 + i, t, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(200, "12 34 !!", "aa"), (201, "tikonor balanor", None), (202, "schwigpfen", None)]
    rows += [(203, "klaupfen" * 4000, "bb"), rows[0], (None, rows[1][1], "bb")]
    return documents(spark, rows, clashing)


def test_language_cases(spark):
    docs = two_languages(spark, clashing=True)
    found = language.language(docs, language.fit_language(docs)).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[201].lang_pred == "aa" and by_id[202].lang_pred == by_id[203].lang_pred == "bb"
    for i in (100, 101, 102, 200):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found) and by_id[None].lang_pred == "bb"


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "abc", None), (2, None, "en")])
    found = language.language(docs, language.fit_language(docs)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    empty = documents(spark, [])
    assert language.language(empty, language.fit_language(empty)).count() == 0


def held(spark, query, label=None, sf=SF):
    rows = query(spark, sf).where("held_out").collect()
    if label is None:
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    else:
        truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return [(r, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]


def test_language_query(spark):
    pairs = held(spark, queries.op3_language)
    assert np.mean([r.lang_pred == lang for r, lang in pairs]) > 0.98


def test_quality_query(spark):
    pairs = held(spark, queries.op5_quality, "quality")
    assert np.mean([r.predicted == y for r, y in pairs]) > 0.95
    every = queries.op5_quality(spark, SF).collect()
    assert len(every) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in every)


def test_toxicity_query(spark):
    # the smaller tables have too few toxic texts to learn from
    pairs = held(spark, queries.op10_toxicity, "toxic", "/root/testdata/sf0.1")
    toxic = [r.predicted for r, y in pairs if y == 1]
    clean = [r.predicted for r, y in pairs if y == 0]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.06


def test_votes_equal_all_cosines():
    rng = random.Random(3)
    good = [" ".join(prose(i, rng.randrange(20, 90))) for i in range(60)]
    bad = [" ".join(w + "###" for w in prose(i, rng.randrange(20, 90))) for i in range(60)]
    model = quality.LatentVotes(rank=8, neighbours=5).fit(good + bad, [1] * 60 + [0] * 60)
    texts = ["plain words here " * 9, "loud### words###", "Mixed### words here", None, ""]
    got = model.score(texts)
    for text, score in zip(texts, got):
        vector = model._unit(model._weighted([quality.terms(text)]) @ model.basis)[0]
        cosine = [float(vector @ v) for v in model.vectors]
        near = sorted(range(120), key=lambda i: -cosine[i])[:5]
        weight = [max(0.0, min(1.0, cosine[i])) ** quality.SHARPNESS for i in near]
        wanted = sum(w * model.labels[i] for w, i in zip(weight, near)) / max(sum(weight), 1e-9)
        assert score == pytest.approx(wanted, abs=1e-4)
    assert got[0] > 0.9 and got[1] < 0.1 and got[3] == got[4] == 0.0


def test_misspelt_words_share_ngrams():
    rng = random.Random(1)
    clean = [" ".join(prose(i, 60)) for i in range(120)]
    toxic = []
    for i in range(120):
        words = prose(1000 + i, 60)
        for _ in range(3):
            words[rng.randrange(60)] = rng.choice(["idiot", "worthless", "moronic"])
        toxic.append(" ".join(words))
    model = toxicity.SubwordSoftmax().fit(clean + toxic, [0] * 120 + [1] * 120)
    plain = " ".join(prose(5000, 60))
    texts = [plain, plain + " idiots idiott", plain + " worthlesss worthles worthless"]
    scores = toxicity._score(texts, toxicity._Words(model.weights), model.bias)
    assert scores[0] < 0.5 < scores[1] and scores[2] > 0.5


def test_word_sums_equal_the_average():
    """The cached numbers of words give what averaging all n-grams of the text gives."""
    model = toxicity.SubwordSoftmax()
    model.weights = np.random.default_rng(4).normal(size=toxicity.BUCKETS).astype(np.float32)
    model.bias = 0.3
    for text in ["", None, "!!! ###", "One two, two é漢字 x", "a" * 500, " ".join(prose(1, 90))]:
        flat, count = toxicity.word_ngrams(toxicity.words_of(text))
        mean = model.weights[flat].mean() if len(flat) else 0.0
        score = toxicity._score([text], toxicity._Words(model.weights), model.bias)[0]
        assert score == pytest.approx(1 / (1 + math.exp(-(0.3 + mean))), rel=1e-4)
        assert count.sum() == len(flat)


@pytest.mark.parametrize("fit, apply", [
    (quality.fit_quality, quality.quality),
    (toxicity.fit_toxicity, toxicity.toxicity),
])
def test_odd_rows(spark, fit, apply):
    rows = list(enumerate(ODD_TEXTS)) + [(50, "x " * 60000), (3, "one"), (None, "null id")]
    docs = documents(spark, rows, clashing=True)
    for marks in (labels(spark, []), labels(spark, [(i, i % 2, i % 2) for i in range(9)])):
        found = apply(docs, fit(docs, marks)).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    empty = documents(spark, [])
    assert apply(empty, fit(empty, labels(spark, []))).count() == 0


def test_repeated_and_contradictory_labels(spark):
    from repolume.llm.common import one_label

    marks = labels(spark, [(1, 0, 0), (1, 1, 1), (2, None, 0), (None, 1, 1), (3, 7, 0)])
    assert [tuple(r) for r in one_label(marks, "quality").collect()] == [(1, 1)]


def test_keep_good_passes_other_columns(spark):
    docs = documents(spark, [(1, "fine words here"), (2, None), (None, "more words")], clashing=True)
    model = quality.LatentVotes().fit(["fine words here"] * 3, [1, 1, 1])
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, None}
