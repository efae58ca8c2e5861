"""Accuracy on rows that were never learned from, on the driver's small tables."""

import os

import pytest

from bazaarline.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no driver tables")


def test_quality_ranks_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in queries.op3_quality(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([r.score for r in got if labels[r.doc_id] == y] for y in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) >= 0.98
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) >= 0.95


def test_language_of_held_out_documents(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op5_language(spark, SF).collect() if r.held_out and known[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 200 and sum(r.lang_pred == known[r.doc_id] for r in got) / len(got) >= 0.98
