import math

import numpy as np

from tonnage.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=300, d=40, seed=1):
    draw = np.random.default_rng(seed)
    scale = np.linspace(2.0, 0.3, d)
    rows = [(k, [float(np.float32(v)) for v in draw.standard_normal(d) * scale], 0) for k in range(n)]
    rows += [(n + k, rows[k][1], 1) for k in range(min(n, 50))] + [(n + 50, rows[0][1], 1)] * 30
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, wanted=16):
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-10 * values[0]).sum()))
    return n, ((n * x - sums) ** 2).sum(axis=1), (n * x - sums) / n @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(found, rows):
    n, deviation, whitened, explained = brute(rows)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    k = len(explained)
    assert len(found) == len(rows) * k
    got = np.array([[by[r[0]][c + 1][0].whitened for c in range(k)] for r in rows])
    sign = np.sign((got * whitened).sum(axis=0))
    np.testing.assert_allclose(got * sign, whitened, atol=1e-9)
    for r, d in zip(rows, deviation, strict=True):
        assert by[r[0]][1][0].deviation == d and by[r[0]][1][0].n == n
    np.testing.assert_allclose([by[rows[0][0]][c + 1][0].explained for c in range(k)], explained, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-9


def test_against_dense_eigenvectors(spark):
    for d in (3, 16, 40, 90):
        df, rows = table(spark, d=d)
        compare(w.whitened(df).collect(), rows)


def test_fewer_vectors_than_components(spark):
    df, rows = table(spark, n=6, d=30)
    rows = rows[:6]
    found = w.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2, 3, 4, 5}
    compare(found, rows)


def test_bad_rows_go_and_clashing_columns_do_not_matter(spark):
    df, rows = table(spark)
    bad = [(900, None, 0), (901, [], 0), (902, [None] + [0.5] * 39, 0), (903, [math.nan] + [0.5] * 39, 0), (904, [math.inf] + [0.5] * 39, 0), (905, [1.0, 2.0], 0), (906, [3e38] + [0.5] * 39, 0)]
    both = df.unionByName(spark.createDataFrame(bad, SCHEMA)).selectExpr("*", "7 as __x", "7 as n", "'a' as key", "1.0 as vector", "2 as component")
    compare(w.whitened(both).collect(), rows)


def test_constant_single_and_empty_tables(spark):
    df, rows = table(spark)
    assert w.whitened(df.limit(0)).count() == 0
    assert w.whitened(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert w.whitened(spark.createDataFrame([(k, [0.5, 0.25], 0) for k in range(9)], SCHEMA)).count() == 0
    null_id = spark.createDataFrame([(None, r[1], 0) for r in rows[:20]], SCHEMA)
    assert w.whitened(null_id).filter("vec_id is null and component = 1").count() == 20


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(k) * 1e9, float(k % 7)], 0) for k in range(40)]
    n, deviation = 40, None
    found = {r.vec_id: r for r in w.whitened(spark.createDataFrame(rows, SCHEMA)).collect() if r.component == 1}
    x = [[math.floor(64 * np.float64(np.float32(v))) + 1_000_000 for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r, own in zip(rows, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        assert found[r[0]].deviation == (deviation if deviation < 1 << 63 else None)
