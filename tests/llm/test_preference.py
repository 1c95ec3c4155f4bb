"""The ranking by preference pairs: held-out labels, the fit itself, and odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import preference, queries

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def ordered_share(scores, good):
    """How many pairs of a good and a bad text are in order."""
    a, b = scores[good], scores[~good]
    return np.mean([(a > x).mean() + (a == x).mean() / 2 for x in b])


def test_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.op11_preference(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [(rows[i]["score"], rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    scores, predicted, good = (np.array(x) for x in zip(*held, strict=True))
    assert ordered_share(scores, good == 1) > 0.98 and (predicted == good).mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(preference.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = preference.train(docs, labels), preference.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bar == b.bar
    again = preference.train(docs.repartition(7), labels.orderBy(F.desc("doc_id")))
    assert np.array_equal(a.weights, again.weights)


def test_weights_minimise_the_logistic_loss_on_differences():
    """Scores are those of the Bradley-Terry model that made the preferences, up to scale; the bar parts the labels."""
    draw = np.random.default_rng(3)
    x, true = draw.normal(size=(3000, 4)), np.array([2.0, -1.0, 0.0, 0.5])
    good = draw.random(3000) < 1 / (1 + np.exp(-(x @ true - 1)))
    ranker = preference.fit(x, good, np.ones(3000))
    found = ranker.weights / ranker.spread
    assert np.dot(found, true) / np.linalg.norm(found) / np.linalg.norm(true) > 0.99
    errors = lambda bar: (good != (ranker.raw(x) >= bar)).sum()
    assert errors(ranker.bar) == min(errors(b) for b in [*ranker.raw(x), np.inf])
    assert ranker.quantile == pytest.approx((ranker.raw(x) < ranker.bar).mean())
    # One class counted tenfold moves the bar, not the order.
    heavy = preference.fit(x, good, np.where(good, 10.0, 1.0))
    assert np.array_equal(heavy.weights, ranker.weights) and heavy.bar < ranker.bar


def test_sample_and_its_weights(spark):
    """A small sample of a label stands for all its rows."""
    r = random.Random(1)
    text = lambda good: " ".join(r.choice(["plain", "words", "here", "stand", "one"]) + ("" if good else "%%% ##") for _ in range(30))
    rows = [(i, text(i % 10 != 0), int(i % 10 != 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    ranker = preference.train(frame, frame.select("doc_id", "quality"), sample_texts=20)
    assert ranker.quantile == pytest.approx(0.1, abs=0.02)
    got = preference.rank(frame, ranker).join(frame, "doc_id")
    assert got.where("predicted <> quality").count() == 0


def test_ranking_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and labels, clashing names, labels of no document, no rows, one label only."""
    rows = [(None, "a b"), (None, None), (1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, "word " * 200_000), (6, "Ünï ☃ 中文 \U0001f600"), (6, "Ünï ☃ 中文 \U0001f600"), *[(i, "Good words stand in this line." if i % 2 else "### *** $$$") for i in range(10, 40)]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("labelled", F.lit(1)).withColumn("measures", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)] + [(10, 0), (11, 0), (12, None), (None, 1), (999, 1), (13, 7)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    ranker = preference.train(docs, labels)
    got = preference.rank(docs, ranker).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == i % 2 for i in range(10, 40))
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert preference.rank(docs.limit(0), ranker).collect() == []
    assert preference.train(docs, labels.where("quality = 1")) is None and preference.train(docs.limit(0), labels) is None
    assert {r["score"] for r in preference.rank(docs, None).collect()} == {0.5}
    assert sum(len(b) for b in preference.blocks("ab " * 100_000)) == 300_000
