import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import quality as Q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return Q.train(Q.counted(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(Q.held_out(F.col("doc_id")))
    rows = Q.score(docs, model).select("doc_id", "quality", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = [r["score"] >= 0.3 for r in rows if r["quality"] == 1]
    bad = [r["score"] < 0.3 for r in rows if r["quality"] == 0]
    print(np.mean(good), np.mean(bad), len(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.95


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (None, "word", "c"), (2, "", "b"), (3, "x" * 300_000, None), (4, "\n" * 1000, "d")]
    got = Q.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1


def test_density_is_the_gaussians(model):
    x = np.array([Q.counts("Some plain words, in a line. And more."), Q.counts("JUNK!! JUNK!! JUNK!!")], float)
    f = Q.features(x, model.rates, model.strength)
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        assert np.isclose(np.linalg.slogdet(cov)[1], model.logdets[k])
        d = f - model.means[k]
        assert np.allclose((d @ np.linalg.inv(cov) * d).sum(1), ((d @ model.factors[k].T) ** 2).sum(1))


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    for some, value in ((labels, None), (labels.limit(0), 0.5)):
        scores = {r["score"] for r in Q.score(docs, Q.train(Q.counted(docs), some)).collect()}
        assert len(scores) == 1 and (scores == {value} or value is None and 0.5 < scores.pop() < 1)
    assert Q.score(docs.limit(0), Q.train(Q.counted(docs), labels)).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(Q.counted(docs), labels), Q.train(Q.counted(docs), flipped)
    assert np.allclose(a.means[0], b.means[0]) and np.allclose(a.factors[1], b.factors[1])


def test_fit_against_numpy(spark, model):
    """Model and scores by NumPy from the rows themselves, at the shrinkages that were chosen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = Q.train(Q.counted(docs), labels)
    rows = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    c, y = np.array([Q.counts(r["text"]) for r in rows], float), np.array([r["quality"] for r in rows])
    rates = c[y == 1][:, 1:].sum(0) / c[y == 1][:, 0].sum()
    assert np.allclose(got.rates, rates)
    x = Q.features(c, rates, got.strength)
    pooled = sum((y == k).sum() * np.cov(x[y == k], rowvar=False) for k in (0, 1)) / len(y)
    odds = []
    for k in (0, 1):
        best = None
        for p in Q.POOLED:
            for d in Q.DIAGONAL:
                v = (1 - p) * np.cov(x[y == k], rowvar=False) + p * pooled
                v = (1 - d) * v + d * np.diag(np.diag(v)) + 1e-4 * np.eye(len(v))
                if np.allclose(np.linalg.inv(got.factors[k].T @ got.factors[k]), v, rtol=1e-6, atol=1e-9):
                    best = v
        e = x - x[y == k].mean(0)
        odds.append(-0.5 * (e @ np.linalg.inv(best) * e).sum(1) - 0.5 * np.linalg.slogdet(best)[1])
    want = odds[1] - odds[0] + np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    assert np.allclose(got.log_odds(c), want, rtol=1e-5, atol=1e-5)


def test_a_label_or_document_many_times(spark):
    """A labelled id repeated in both tables is only more weight: nothing is collected by row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    one = labels.filter(~Q.held_out(F.col("doc_id"))).limit(1)
    many = labels.unionByName(one.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x"))
    more = docs.unionByName(docs.join(one.select("doc_id"), "doc_id").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x"))
    model = Q.train(Q.counted(more), many)
    assert np.isfinite(model.log_odds(np.array([Q.counts("some text")], float))).all()
