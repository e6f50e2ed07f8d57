"""The joins that larger sides take give the same results as the broadcast ones."""

from functools import partial

import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_exact_dedup import TEXTS
from test_exact_dedup import brute as equal
from test_near_dedup import brute as near
from test_near_dedup import corpus

from lumenframe.llm import exact_dedup, html_extract, near_dedup, shared, warc
from lumenframe.scratch import join_checked


@pytest.fixture(autouse=True)
def nothing_is_small(monkeypatch):
    for module in (exact_dedup, near_dedup, shared, warc):
        monkeypatch.setattr(module, "join_checked", partial(join_checked, limit=-1))


def test_exact(spark):
    got = exact_dedup.exact_duplicates(documents(spark, TEXTS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == equal(TEXTS, range(len(TEXTS)))


def test_near(spark):
    texts = corpus()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == near(texts)


def test_pages(spark):
    rows = [(i, f"http://h{i % 3}/", f"<div>same</div><p>text {i % 7}</p>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(df, broadcast_bytes=-1).collect()} == {i: f"text {i % 7}" for i in range(30)}
    kinds = [r.record_type for r in warc.archived(df).collect()]
    assert kinds.count("response") == len({h for *_, h in rows})


def test_survivors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "B"), (3, "c"), (None, "d"), (4, "e"), (4, "f"), (2, "b")], "doc_id long, text string")
    rows = [(1, "a", False), (2, "b", True), (2, "B", False), (3, "c", True), (None, "d", False), (4, "e", False), (4, "f", True), (2, "b", False)]
    decisions = spark.createDataFrame(rows, "doc_id long, t string, kept boolean").withColumn("text_digest", shared.text_digest(F.col("t")))
    assert sorted((r.doc_id, r.text) for r in shared.survivors(docs, decisions, "doc_id").collect()) == [(2, "b"), (3, "c"), (4, "f")]
