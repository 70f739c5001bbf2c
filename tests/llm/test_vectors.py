"""op11 and op13 against plain versions: eigenvectors by numpy, codes by comparing all distances."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.llm import codes, queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x int, code int"


def table(rng, n=300, width=32):
    """Vectors around few centres, with repeated rows, equal vectors, null labels, nulls and values that are not finite."""
    rows = []
    for i in range(n):
        v = [float(a) for a in rng.normal(rng.integers(0, 4), 0.4, width)]
        rows.append((i * 7 % n, v, None if i % 5 == 0 else i % 3))
    rows += [rows[3], rows[3], (n + 1, rows[4][1], 2), (None, rows[5][1], None)]
    rows += [(-1, None, 1), (-2, [None] * width, 1), (-3, [0.0] * (width - 1) + [float("nan")], 1), (-4, [float("inf")] + [0.0] * (width - 1), None)]
    return [(*r, "clash", 1, 2) for r in rows]


def kept(rows):
    out = [(r[0], r[1], r[2]) for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    return [(a, [int(np.floor(256 * c)) for c in v], b) for a, v, b in out]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    ends = [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in ends]

    def near(v, book):
        far = [sum((p - q) ** 2 for p, q in zip(v, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k, (a, b) in enumerate(ends):
            at = [near(r[1][a:b], books[k])[0] for r in rows]
            for e in range(len(books[k])):
                mine = [r[1][a:b] for r, x in zip(rows, at, strict=True) if x == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, label in rows:
        found = [near(v[a:b], books[k]) for k, (a, b) in enumerate(ends)]
        out.append((i, "".join(f"{x:02x}" for x, _ in found), sum(d for _, d in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(i), c, e, sums[label], digest) for i, c, e, label in out)


@pytest.mark.parametrize("n", [300, 20, 6])
def test_codes_equal_a_full_search(spark, tmp_path, n):
    rows = table(np.random.default_rng(n), n)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_sql_and_empty_tables(spark, tmp_path):
    rows = [r for r in table(np.random.default_rng(9)) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = con.execute(queries.ORACLE["op13_vector_codes"]).fetchall()
    got = [tuple(r) for r in queries.op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(map(tuple, sql)) == sorted(got)
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compress(empty)[0].collect() == []
    assert whitening.whiten(empty).collect() == []


def test_partial_distances_keep_ties_and_large_numbers():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, m, d = rng.integers(1, 80), rng.integers(1, 40), rng.integers(1, 9)
        top = 3 if trial % 2 else 1 << 40  # ties; squares beyond a long
        x, book = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (m, d))
        far = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        want = [row.tolist().index(min(row.tolist())) for row in far]
        at, error = codes.nearest(x, book)
        assert at.tolist() == want
        assert [int(e) for e in error] == [int(r[w]) for r, w in zip(far, want, strict=True)]


def test_search_visits_wide_dimensions_first():
    book = np.array([[0, 5, 100], [0, -5, -100], [1, 0, 3]])
    assert codes.order(book).tolist() == [2, 1, 0]


def test_odd_widths(spark):
    """Rows of another width get null codes; a width that the parts do not divide is cut all the same."""
    rows = [(i, [float(i % 5), 1.0, 2.0 * i], i % 2) for i in range(40)] + [(100, [1.0], 0), (101, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = codes.compress(df, parts=2, entries=4)
    assert [b.shape[1] for b in books] == [1, 2]
    got = {r.id: r for r in coded.collect()}
    assert len(got) == 42 and got[100].code is None and got[101].error is None and len(got[0].code) == 4
    assert got[100].label_error == got[0].label_error
    white = {(r.id, r.component): r for r in whitening.whiten(df, components=4).collect()}
    assert len(white) == 42 * 3 and white[100, 1].whitened is None and white[100, 1].deviation is None and white[0, 1].deviation > 0


def plain_whitening(rows, components=4):
    rows = kept(rows)
    x = np.array([r[1] for r in rows], np.float64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    by = np.argsort(-values)[:components]
    white = (x - fit.mean(axis=0)) @ axes[:, by] / np.sqrt(values[by])
    whole = [[int(c) for c in f] for f in fit]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    apart = [sum((len(fit) * c - s) ** 2 for c, s in zip(r[1], sums, strict=True)) for r in rows]
    return rows, len(fit), white, values[by] / values.sum(), apart


def test_whitening_equals_numpy(spark, tmp_path):
    rows = table(np.random.default_rng(5), 400, 24)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    want, n, white, explained, apart = plain_whitening(rows)
    assert len(got) == 4 * len(want)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for (i, _, _), w, a in zip(want, white, apart, strict=True):
        for k in range(4):
            r = by[i, k + 1].pop()
            assert (r.n, r.deviation) == (n, a)
            signs.setdefault(k, np.sign(r.whitened * w[k]))
            assert abs(r.whitened - signs[k] * w[k]) < 1e-8
            assert abs(r.explained - explained[k]) < 1e-10 and r.identity_error < 1e-9
    assert not any(by.values())


def test_jacobi_keeps_small_eigenvalues():
    """Of a graded matrix eigenvalues over thirty orders of magnitude come out to working precision."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        b = rng.normal(size=(n, n))
        core = b @ b.T + n * np.eye(n)
        d = 10.0 ** np.linspace(0, -15, n)
        values, axes = whitening.jacobi(core * d[:, None] * d[None])
        assert np.abs(axes @ axes.T - np.eye(n)).max() < 1e-12
        assert (np.diff(values) <= 0).all() and (values > 0).all()
        # the product of all is the determinant, which small ones dominate
        want = np.linalg.slogdet(core)[1] + 2 * np.log(d).sum()
        assert abs(np.log(values).sum() - want) < 1e-9 * max(1, abs(want))
    values, axes = whitening.jacobi(np.ones((6, 6)))
    assert abs(values[0] - 6) < 1e-12 and np.abs(values[1:]).max() < 1e-12
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitening_without_spread(spark):
    """One distinct vector, and fewer vectors than dimensions: components without variance are null."""
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    few = spark.createDataFrame([(i, [float(i), float(i * i), 0.0, 1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = whitening.whiten(few).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2}
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening_far_from_zero(spark):
    """Squares beyond a long: deviations there are null, the rest is as always."""
    df = spark.createDataFrame([(i, [3e14 * i, 1.0 * (i % 2)]) for i in range(20)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert all(r.deviation is None for r in got if r.id in (0, 19)) and all(r.whitened is not None for r in got)
