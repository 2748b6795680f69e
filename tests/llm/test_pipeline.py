from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from echofield.llm import simhash
from echofield.llm.common import shared_table

from test_simhash import classes, fingerprint


def test_stages_on_odd_rows(spark, odd, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "surrogates", "packing"]
    docs = odd
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, ""), name)
        seen[name] = docs
    for name in ("language_id", "near_dedup", "surrogates"):
        assert seen[name].columns == odd.columns
    lettered = [d for d in odd_docs if d[1] and any(c.isalpha() for c in d[1])]
    assert seen["language_id"].count() == len(lettered)
    assert seen["near_dedup"].count() == len(set(classes([fingerprint(d[1]) for d in lettered])))
    ends = seen["surrogates"].collect()
    assert len(ends) == seen["near_dedup"].count() and all(r["n_chars"] == len(r["text"]) for r in ends)
    assert not any("7713" in r["text"] for r in ends)
    packed = seen["packing"].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in ends}
    assert all(len(r["ids"]) == 4 * r["length"] for r in packed)


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run_on_a_test_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    assert rows.select("sequence_id").distinct().count() == rows.count()


def test_texts_without_any_label_stay(spark, odd, odd_docs):
    kept = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), "")
    assert kept.columns == odd.columns
    want = [d[1] for d in odd_docs if d[1] and any(c.isalpha() for c in d[1])]
    assert sorted(r["text"] for r in kept.collect()) == sorted(want)


def test_near_dedup_broadcasts_no_probes(spark, odd, monkeypatch):
    plans, whole = [], simhash.components

    def watched(edges):
        plans.append(edges._jdf.queryExecution().sparkPlan().toString())
        return whole(edges)

    monkeypatch.setattr(simhash, "components", watched)
    corpus_pipeline.near_dedup(spark, odd, "")
    assert len(plans) == 1 and re.search(r"SortMergeJoin \[seg#\d+, at#\d+L\]", plans[0])
    assert not re.search(r"BroadcastHashJoin \[seg#\d+, at#\d+L\]", plans[0])
