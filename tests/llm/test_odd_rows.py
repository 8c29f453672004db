"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables through every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hyplab.llm import (
    line_rules, line_templates, mixing, near_duplicates, packing, quality_classifier, sentence_spans, sharding, simhash, toxicity,
)


def quality(docs, labels):
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels))


def toxic(docs, labels):
    taught = toxicity.weak_categories(docs, toxicity.sample_labels(labels.withColumn("toxic", F.col("quality"))))
    return toxicity.score(docs, toxicity.fit(taught, (*toxicity.SEEDS, "toxic")))


def mixed(docs, labels):
    m = mixing.measure(docs)
    return mixing.take(m, mixing.plan(m, mixing.targets(m)))


PER_ROW = {
    "quality": quality, "toxic": toxic, "sentence_spans": lambda d, _: sentence_spans.remove_repeats(d),
    "near_duplicates": lambda d, _: near_duplicates.near_duplicates(d), "line_rules": lambda d, _: line_rules.clean_lines(d),
    "sharding": lambda d, _: sharding.shard(d), "mixing": mixed, "simhash": lambda d, _: simhash.fingerprints(d),
    "templates": lambda d, _: line_templates.drop_recurring(d),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, None), (None, 1), (8, 0)], "doc_id long, quality int")


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(odd, labels, name):
    got = PER_ROW[name](odd, labels).select("doc_id").collect()
    want = odd.select("doc_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("name", [*PER_ROW, "packing"])
def test_empty_table(odd, labels, name):
    fn = PER_ROW.get(name) or (lambda d, _: packing.pack(d))
    assert fn(odd.where("false"), labels).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    got = near_duplicates.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[7]["component_id"] == 7
    nameless = sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None)
    assert nameless == [(0, None, True), (1, 4, False)]


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, capacity=1000).collect()
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 6) == 60000
    assert len([r for r in rows if r["doc_id"] == 8]) == 2
    assert len({r["sequence_id"] for r in rows if r["doc_id"] == 8}) == 2
    assert all(r["used"] <= 1000 for r in rows)


def test_pipeline_runs_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == list(corpus_pipeline.DOCUMENT), name
        assert 0 < docs.count()
    assert docs.select("doc_id").distinct().count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    size = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    assert packed.agg(F.sum("n_words")).first()[0] == docs.agg(F.sum(size)).first()[0]


def test_pipeline_takes_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.collect()
