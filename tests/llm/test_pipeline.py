"""The stages, one by one, against brute force."""

import numpy as np

import corpus_pipeline
from repolume.llm import packing, queries
from tests.llm.helpers import (
    ODD_TEXTS,
    base_spans,
    contamination,
    documents,
    prose,
    similar_components,
)

SF = "/root/testdata/sf0.001"


def staged(spark, count):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:count]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    return docs


def test_order_of_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "benchmark", "secrets", "packing"]


def test_quality_stage_keeps_clean_documents(spark):
    kept = {r.doc_id for r in staged(spark, 1).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in marks if r.quality == 1]
    bad = [r.doc_id in kept for r in marks if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_quality_stage_keeps_what_the_classifier_keeps(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.filter_quality(spark, docs, sf_dir).collect()}
    judged = queries.op5_quality(spark, sf_dir).collect()
    assert any(0.5 <= r.score < 0.7 for r in judged)
    assert kept == {r.doc_id for r in judged if r.predicted}


def near_rows():
    base = prose(1, 100)
    texts = [" ".join(base), " ".join(base[:97] + ["x"]), "apart " + " ".join(prose(2, 50))]
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    rows += [(i, t) for i, t in enumerate(ODD_TEXTS[:4])]
    return rows + [rows[0], (12, "other text of an id"), (None, texts[0]), (None, "null and alone")]


def test_near_copies_stage(spark):
    rows = near_rows()
    docs = documents(spark, rows, clashing=True)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    wanted = []
    groups = similar_components(rows, 5, 80)
    for number in {g for _, g in groups if g is not None}:
        members = [r for r, (_, g) in zip(rows, groups) if g == number]
        wanted.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    wanted += [r for r, (_, g) in zip(rows, groups) if g is None]
    assert got == sorted((str(i), str(t)) for i, t in wanted)


def test_benchmark_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_benchmark(spark, docs, SF).collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hits = contamination(rows, [tuple(i) for i in items])
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r, h in zip(rows, hits) if not h[1])


def test_secrets_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert out.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in out.collect()}
    assert set(before) == set(after) and any(base_spans(t) for t in before.values())
    for doc_id, text in before.items():
        new = after[doc_id]
        assert not base_spans(new.text) and new.n_chars == len(new.text)
        if not base_spans(text) and "[SECRET]" not in new.text:
            assert new.text == text


def test_stages_take_odd_rows(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "null id"), (3, "one"), (60, "y " * 40000)]
    for sample in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            docs = documents(spark, sample, clashing=True)
            out = stage(spark, docs, SF)
            assert out.count() <= max(len(sample), 100)
            assert name == "packing" or out.columns == docs.columns


def test_stages_keep_odd_rows(spark):
    """Null and empty texts, texts without words and null ids stay in the stages that have
    nothing to say about them; of texts with words, one of each."""
    rows = list(enumerate(ODD_TEXTS)) + [(None, "null id"), (None, None), (1, None), (3, "one")]
    docs = documents(spark, rows, clashing=True)
    for stage in (corpus_pipeline.drop_benchmark, corpus_pipeline.redact_secrets):
        got = [(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(rows[:-1], key=str)


def test_run(spark):
    kept = {r.doc_id: r.text for r in staged(spark, 4).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    tokens = packing.WordTokens(packing.public_tokenizers.path(packing.VOCABULARY))
    total = sum(len(t) // 4 + 1 for t in tokens.encode([t.encode() for t in kept.values()]))
    assert sum(r.length for r in rows) == total
