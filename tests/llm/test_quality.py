import zlib

import duckdb
import numpy as np
from helpers import documents, empty

from lumenframe.llm.quality import FEATURES, THRESHOLD, accepted, features, fit, fit_on_labels, scored

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_on_labels(docs, labels)
    rows = {r.doc_id: r for r in scored(docs, model).collect()}
    truth = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    own = [i for i in truth if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    y, s = np.array([truth[i] for i in own]), np.array([rows[i].score for i in own])
    assert auc(s, y) > 0.99 and ((s >= THRESHOLD) == y).mean() > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in rows.values())
    kept = {r.doc_id for r in accepted(docs, model).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_ranking_recovers_known_weights():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((4000, len(FEATURES)))
    true = draw.standard_normal(len(FEATURES))
    y = (draw.random(4000) < 1 / (1 + np.exp(-3 * x @ true))).astype(int)
    model = fit(x, y)
    assert np.corrcoef(np.array(model.weights), true)[0, 1] > 0.98
    worth = model.worth(x)
    assert abs((model.score(x) < THRESHOLD).mean() - (y == 0).mean()) < 0.02  # the quantile
    assert (np.diff(model.score(x)[np.argsort(worth)]) >= 0).all()


def test_only_the_text_matters(spark):
    docs = documents(spark, ["some words here."] * 3 + [None, "", " "], [1, 99, None, 4, 5, 6])
    model = fit(np.random.default_rng(0).random((50, len(FEATURES))), np.arange(50) % 2)
    rows = scored(docs, model).collect()
    assert len({r.score for r in rows[:3]}) == 1 and len({r.score for r in rows[3:]}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert scored(empty(spark), model).collect() == [] and accepted(empty(spark), model).collect() == []
    assert accepted(docs, model).columns == docs.columns


def test_labels_that_say_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a b.", "c d", "e", None])
    for labels in (none, ones):
        assert scored(docs, fit_on_labels(docs, labels)).where("predicted = 1").count() == 4
    assert fit_on_labels(empty(spark), ones).weights == (0.0,) * len(FEATURES)


def test_features_of_extremes():
    for text in (None, "", "  \n", "x", "É" * 9, "a " * 100_000, "\ud800", "🎉"):
        got = features(text)
        assert len(got) == len(FEATURES) and np.isfinite(got).all()


def test_repeated_rows_change_nothing(spark):
    texts = [f"some good words number {i}, here." if i % 2 else f"$$ {i} | | {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = (fit_on_labels(documents(spark, texts * n, [*range(60)] * n), labels, rows=30) for n in (1, 9))
    assert once == often and any(often.weights)
