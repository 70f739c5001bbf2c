"""op12: parts against plain versions, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.llm import queries, rff

SF = "/root/testdata/sf0.1"


def plain_isotonic(total, good):
    """max over starts of min over ends of the mean, the textbook form."""
    n = len(total)
    return [max(min(sum(good[i : j + 1]) / sum(total[i : j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_isotonic():
    rng = np.random.default_rng(2)
    for _ in range(30):
        total = rng.integers(1, 9, rng.integers(1, 25)).astype(float)
        good = np.floor(total * rng.random(len(total)))
        assert np.allclose(rff.isotonic(total, good), plain_isotonic(total.tolist(), good.tolist()))


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(4)
    p = len(rff.STATISTICS)
    turn, shift = rng.standard_normal((p, 20000)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, 20000)
    model = rff.Model(np.zeros(p), np.ones(p), turn, shift, np.zeros(20001), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(12, p))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * p))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_statistics_of_whole_texts():
    names = dict(zip(rff.STATISTICS, rff.statistics("AB cd!! ef$\n\nAB cd!! ef$"), strict=True))
    assert names["dup_lines"] == 0.5 and names["repeated"] == 1.0 and names["upper"] == 4 / 12 and names["odd_words"] == 4 / 6
    assert rff.statistics(None) == rff.statistics("") == [0.0] * len(rff.STATISTICS)
    # the last words count: no prefix is taken
    assert rff.statistics("word " * 50_000 + "x!!") != rff.statistics("word " * 50_000 + "xyz")
    assert all(np.isfinite(rff.statistics(t)).all() for t in (" ", "\n\n", "é", "\ud800", "x" * 100_000))


def test_normal_equations_equal_the_direct_solution(spark):
    rng = np.random.default_rng(6)
    p, size = len(rff.STATISTICS), 17
    x, y = rng.normal(size=(500, p)), rng.integers(0, 2, 500)
    model = rff.Model(np.zeros(p), np.ones(p), rng.normal(size=(p, size - 1)), rng.uniform(0, 6, size - 1), np.zeros(size), np.zeros(0), np.zeros(0))
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int").repartition(7)
    z = model.features(x)
    shrink = np.full(size, 0.01 * 500)
    shrink[-1] = 0
    want = np.linalg.solve(z.T @ z + np.diag(shrink), z.T @ y)
    assert np.allclose(rff._ridge(rows, model, size, 0.01), want, atol=1e-9)


def test_held_out_rows_are_told_apart(spark):
    got = queries.op12_rff_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, r.predicted, quality[r.doc_id]) for r in got if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert len(bad) > 50
    assert sum(h[1] for h in good) / len(good) > 0.98 and sum(h[1] for h in bad) / len(bad) < 0.05
    scores, mark = np.array([h[0] for h in held]), np.array([h[2] for h in held])
    for lo, hi in ((0, 0.3), (0.9, 1.01)):  # calibrated: rates are like scores
        at = (scores >= lo) & (scores < hi)
        assert abs(scores[at].mean() - mark[at].mean()) < 0.05


def test_labels_held_out_are_never_learnt(spark):
    """Turning the held-out labels round changes no score, nor do language, source and order of rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in rff.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in rff.classify(docs.withColumns({"lang": F.lit(None), "source": F.lit("x")}).repartition(5), turned).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None), (None, 0, 0)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "clash"), (2, None, ""), (2, "", ""), (None, "x", None)], "doc_id long, text string, score string")
    got = rff.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    known = {i for i, quality, _ in labels if i is not None and quality is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    n = sum(r.doc_id in known for r in got)  # all good
    assert got[0].score == (n + 1) / (n + 2)
    assert rff.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
