"""Whitening against a covariance and its eigenvectors worked out in one piece."""

import math

import numpy as np
import pytest

from evidentia.llm import whiten
from evidentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def compare(got, rows, k=4):
    """Rows of the result against rows (id, vector) that take part."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fitted = sorted(set(map(tuple, x.values())))
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[v - s / n for v, s in zip(f, sums, strict=True)] for f in fitted])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i, _ in rows for c in range(1, min(k, len(sums)) + 1))
    signs = {}
    for r in got:
        v, j = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert r["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-6)
        assert r["identity_error"] < 1e-6
        want = float((np.array(v) - np.array(sums) / n) @ vectors[:, j] / np.sqrt(values[j]))
        if abs(want) > 1e-3:
            signs.setdefault(j, np.sign(want * r["whitened"]))
        assert r["whitened"] == pytest.approx(signs.get(j, 1) * want, abs=1e-5)


def test_query_whitens_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compare(QUERIES["op11_whitening"](spark, SF).collect(), rows)


def test_rows_that_take_no_part_and_copies(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.standard_normal(5) * [5, 3, 2, 1, 0.3]).tolist()) for i in range(300)]
    copies = [(1000 + i, good[7][1]) for i in range(500)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [math.nan] * 5), (2004, [1.0, 1.0, 1.0, 1.0, math.inf]), (2005, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "other") for i, v in good + copies + bad], "vec_id long, embedding array<double>, x string").repartition(7)
    compare(whiten.whiten(frame).collect(), good + copies)
    assert whiten.whiten(frame.where("vec_id >= 2000 and vec_id < 2005")).count() == 0
    assert whiten.whiten(frame.limit(0)).count() == 0


def test_no_variance_and_large_entries(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id int, embedding array<float>")
    got = whiten.whiten(frame).collect()
    assert len(got) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got} == {(1, 0, None, 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 0.5, -3.0]) for i in range(40)], "vec_id int, embedding array<float>")
    for r in whiten.whiten(flat).collect():
        assert (r["whitened"] is None) == (r["component"] > 1)
    far = spark.createDataFrame([(1, [4e9]), (2, [-4e9]), (3, [0.0])], "vec_id int, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in whiten.whiten(far).collect()} == {1: None, 2: None, 3: 0}


def test_merging_loses_nothing():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((500, 12)) * 100 + 1000).astype(np.int64)
    parts = [whiten.summary(p) for p in np.array_split(x, [1, 3, 40, 41, 300])]
    whole = whiten.merge_all(iter(parts))
    centred = x - x.mean(axis=0)
    assert whole.n == 500 and whole.sums == x.sum(axis=0).tolist()
    assert whole.scaled.T @ whole.scaled == pytest.approx(centred.T @ centred, rel=1e-9)


def test_a_tree_of_several_levels(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(400)]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = whiten.whole_numbers(many, "embedding", 3).select("x").distinct().repartition(40)
    one, tree = whiten.fit(x.coalesce(1), 3), whiten.fit(x, 3)
    assert one.n == tree.n and one.sums == tree.sums and tree.variances == pytest.approx(one.variances, rel=1e-9)
