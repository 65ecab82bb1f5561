import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tessellum.llm import common, quality, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_keep_columns_and_take_edge_rows(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, none, SF).count() == 0, name


def test_near_duplicates_go_and_others_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: shingles(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    alike = lambda a, b: len(text[a] & text[b]) / len(text[a] | text[b])
    pairs = [(a, b) for a in text for b in text if a < b and alike(a, b) >= 0.8]
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.01 * len(pairs)
    for gone in set(text) - kept:
        assert max(alike(gone, b) for b in text if b != gone) >= 0.8


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.quality_filter(docs)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "exact"] and out.where("not exact").count() == 0
    assert 0 < out.select("doc_id").distinct().count() <= good.count()


def test_repeated_rows_and_ids_on_two_texts(spark, docs):
    kept = simhash.without_near_duplicates(docs.drop("size"))
    assert kept.count() == kept.distinct().count()
    found = [(r.doc_id, hashlib.md5((r.text or "").strip().encode()).hexdigest()) for r in kept.select("doc_id", "text").collect()]
    assert len(found) == len(set(found)) and any(d is None for d, _ in found)
    assert sum((t or "").split() == [] for t in (r.text for r in kept.select(F.col("text")).collect())) == 1


def test_near_duplicates_are_the_same_with_few_and_many_keys(spark, docs, monkeypatch):
    rows = docs.unionByName(docs)
    few = sorted(map(str, simhash.without_near_duplicates(rows).collect()))
    monkeypatch.setattr(common, "FEW_KEYS", 0)
    assert sorted(map(str, simhash.without_near_duplicates(rows).collect())) == few
