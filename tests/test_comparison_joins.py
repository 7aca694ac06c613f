"""Semi and anti joins by comparisons, in ranges instead of pairs."""

import math

import pytest

from relplan.operators import joins as J

NAN = math.nan


@pytest.mark.parametrize("on", ["b.p < a.x AND b.q > a.y + 2e0", "a.x >= b.p AND a.y >= b.q", "b.p > a.x AND b.q <= a.y", "a.x <= b.p AND b.q < a.y", "b.p = a.x AND b.q > a.y", "a.x < b.p", "b.q >= a.y", "a.x < b.p AND a.y + b.q > 3e0"])
def test_comparisons_against_all_pairs(spark, on):
    """Nulls, NaN, zeros of both signs, equal values, types that differ, rows that repeat; the ranges part equal values."""
    doubles = [None, NAN, -0.0, 0.0, 1.0, 1.5, -3.0, 4.0]
    left = [(x, y) for x in (None, 0, 1, 2, 5) for y in doubles] * 2
    right = [(p, q) for p, q in zip([0, 1, 1, 2, 4, None, 2, 3], doubles, strict=True)]
    a, b = spark.createDataFrame(left, "x int, y double"), spark.createDataFrame(right, "p long, q double")
    a.createOrReplaceTempView("a_rows"), b.createOrReplaceTempView("b_rows")
    for kind, how in (("semi", ""), ("anti", "NOT")):
        for some in (b, b.where("false")):
            some.createOrReplaceTempView("b_rows")
            want = spark.sql(f"SELECT * FROM a_rows a WHERE {how} EXISTS (SELECT 1 FROM b_rows b WHERE {on})")
            got = J.nested_loop_semi_join(a, some, on, kind, ("a", "b"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_pairs_are_built(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (spark.range(200_000).selectExpr(f"id AS {x}", f"CAST(hash(id) AS DOUBLE) AS {y}") for x, y in ("xy", "pq"))
        on = "b.p < a.x AND b.q > a.y"
        plan = J.nested_loop_semi_join(a, b, on, "semi", ("a", "b"))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "explode" not in plan and "Window" in plan
        rows = [r.h for r in spark.range(200_000).selectExpr("hash(id) AS h").collect()]
        best, met = -math.inf, 0
        for h in rows:
            met, best = met + (best > h), max(best, h)
        assert J.nested_loop_semi_join(a, b, on, "semi", ("a", "b")).count() == met and J.nested_loop_semi_join(a, b, on, "anti", ("a", "b")).count() == 200_000 - met
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
