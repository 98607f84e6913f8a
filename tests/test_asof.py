"""As-of lookups by merge, against each row's own search."""

import datetime
import random

import pytest

from evidentia.operators import resolve

START = datetime.date(2000, 1, 1)


def made(rng, keys, with_gaps):
    versions = []
    for k in range(keys):
        day = START + datetime.timedelta(rng.randrange(50))
        for seq in range(rng.randrange(1, 9)):
            end = day + datetime.timedelta(rng.randrange(1, 200))
            last = rng.random() < 0.2
            versions.append((k, seq, day, None if last else end))
            if last:
                break
            day = end + datetime.timedelta(rng.randrange(0, 30) if with_gaps else 0)
    return versions


@pytest.mark.parametrize("hot", [10**9, 40, 3])
@pytest.mark.parametrize("with_gaps", [False, True])
def test_each_row_meets_the_version_in_force(spark, monkeypatch, hot, with_gaps):
    """Half of all rows have one key, a fifth of these one day; null keys and days meet nothing."""
    monkeypatch.setattr(resolve, "HOT_ROWS", hot)
    rng = random.Random(hot)
    versions = made(rng, 12, with_gaps)
    rows = []
    for i in range(2000):
        k = 3 if i % 2 else rng.randrange(14)
        d = START + datetime.timedelta(100 if i % 10 == 1 else rng.randrange(1500))
        rows.append((i, k, d))
    rows += [(5000, None, START), (5001, 3, None), (7, 3, START + datetime.timedelta(100)), (7, 3, START + datetime.timedelta(100))]
    left = spark.createDataFrame(rows, "n int, k int, d date").repartition(5)
    right = spark.createDataFrame(versions, "k int, seq int, effective_from date, effective_to date").repartition(3)
    got = sorted((r["n"], r["k"], r["d"], r["seq"]) for r in resolve.as_of_day(left, right, "k", "d", ["seq"]).collect())
    want = sorted((n, k, d, s) for n, k, d in rows for kk, s, a, b in versions if k is not None and d is not None and k == kk and a <= d and (b is None or d < b))
    assert got == want and len(got) > 300


def test_hot_keys_are_cut_into_ranges_of_like_size(spark, monkeypatch):
    monkeypatch.setattr(resolve, "HOT_ROWS", 100)
    rows = spark.range(10_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS k", "date_add(DATE'2000-01-01', CAST(id % 365 AS int)) AS d")
    cuts = {r["k"]: r["cuts"] for r in resolve.hot_ranges(rows, "k", "d").collect()}
    assert list(cuts) == [1] and 10 <= len(cuts[1]) <= 16 and cuts[1] == sorted(cuts[1])
    assert resolve.hot_ranges(rows.where("id % 2 = 1") if "id" in rows.columns else rows.where("k > 1"), "k", "d") is None
    empty = spark.createDataFrame([], "k int, seq int, effective_from date, effective_to date")
    assert resolve.as_of_day(rows, empty, "k", "d", ["seq"]).count() == 0


def test_the_plan_joins_no_row_with_versions(spark):
    versions = spark.createDataFrame([(1, 0, START, None)], "k int, seq int, effective_from date, effective_to date")
    rows = spark.createDataFrame([(1, START)], "k int, d date")
    plan = resolve.as_of_day(rows, versions, "k", "d", ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1
