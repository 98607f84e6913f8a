"""What comparisons of many pairs of reports cost."""

import random

import pytest

import __spark_entry__
from evidentia.operators import compare

QUERIES = __spark_entry__.queries()


def plan_of(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" :+-*()0123456789") for x in plan.splitlines()]
    return {k: sum(x.startswith(k + " ") for x in lines) for k in ("Exchange", "Sort", "Window", "ObjectHashAggregate")}


@pytest.mark.parametrize("name", ["compare_change_order", "compare_removed", "compare_unresolved"])
def test_findings_need_one_shuffle(spark, name):
    """Lines are shuffled once, numbered in one pass and sorted once more; nothing is gathered in lists of a group."""
    seen = plan_of(spark, name)
    assert seen["Exchange"] == 1 and seen["Sort"] <= 3 and seen["ObjectHashAggregate"] == 0


@pytest.mark.parametrize("name", ["compare_status_changes", "compare_evidence_changes"])
def test_changes_in_place_count_nothing(spark, name):
    """Numbers and neighbours are all that changes in place need: two windows, no aggregation."""
    seen = plan_of(spark, name)
    assert seen["Exchange"] == 1 and seen["Sort"] == 2 and seen["Window"] == 2 and seen["ObjectHashAggregate"] == 0


@pytest.mark.parametrize("kind", ["status", "evidence"])
def test_changes_in_place_sort_numbers_alone(spark, kind):
    """The second sort compares no texts, and what the asked type does not compare is not carried."""
    plan = QUERIES[f"compare_{kind}_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sorts = [x[x.index("Sort [") :] for x in plan.splitlines() if "Sort [" in x]
    assert not any(c in x for x in sorts for c in ("locator", "title", "provision"))
    assert any("item_number" in x and "side" in x for x in sorts)
    assert ("evidence" if kind == "status" else "status#") not in "".join(x for x in plan.splitlines() if " Window [" in x)


def test_changes_in_place_are_those_of_all_changes(spark):
    """Nulls anywhere, numbers with gaps on either side, items that change their place or their reference."""
    rng = random.Random(6)
    pick = lambda *values: rng.choice(values)
    rows = [(pair, side, n, pick("a", "b", None), pick("t", "u", None), pick("p", None), pick("x", "y", None), pick("r", "s", None), pick(["e"], ["f"], [], None)) for pair in range(150) for side in (0, 1) for n in range(1, 9) if rng.random() < 0.8]
    both = spark.createDataFrame(rows, "pair int, side int, item_number int, locator string, title string, provision string, status string, reason_code string, evidence array<string>").repartition(3)
    told = lambda frame: sorted(map(tuple, frame.collect()))
    every = compare.changes(both)
    for kinds in (["status"], ["evidence"], ["status", "evidence"]):
        want = told(every.where(every["type"].isin(kinds)))
        assert told(compare.in_place_changes(both, *kinds)) == want and want
