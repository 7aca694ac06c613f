"""Joins on keys that repeat on both sides, dealt into blocks."""

import pytest
from pyspark.sql import functions as F

from relplan.operators import joins as J


@pytest.mark.parametrize("join", [J.sort_merge_join, J.hash_join])
@pytest.mark.parametrize("preserve", list(J.PRESERVE))
def test_repeated_keys_are_dealt(spark, monkeypatch, join, preserve):
    """Hot keys, nulls, identical rows, keys of one side only, types that differ: each pair once, over many tasks."""
    for name, value in (("PAIRS", 64), ("LEFT_ROWS", 8), ("ROWS", 16), ("PARTITION_PAIRS", 100)):
        monkeypatch.setattr(J, name, value)
    left = [(1, i) for i in range(40)] + [(None, i % 2) for i in range(20)] + [(2, 7)] * 30 + [(3, 0)] + [(5, i) for i in range(50)]
    right = [(1, i) for i in range(33)] + [(None, i) for i in range(9)] + [(2, 7)] * 3 + [(3, i) for i in range(90)] + [(6, i) for i in range(50)] + [(8, 1)]
    a, b = spark.createDataFrame(left, "k int, v long").repartition(3), spark.createDataFrame(right, "k long, v long").repartition(3)
    want = [x + y for x in left for y in right if x[0] == y[0]]
    want += [(*x, None, None) for x in left if preserve in ("left", "both") and x[0] not in {y[0] for y in right}]
    want += [(None, None, *y) for y in right if preserve in ("right", "both") and y[0] not in {x[0] for x in left}]
    joined = J.flat(join(a, ["k"], b, ["k"], preserve))
    parts = [n for (n,) in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(parts) >= 10 and max(parts) < len(want) / 4
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(want, key=str)


def test_floating_keys_meet(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS", 4)
    a, b = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)] * 5, "k double"), spark.createDataFrame([(-0.0,), (float("nan"),), (None,), (1.0,)] * 5, "k float")
    for join in (J.sort_merge_join, J.hash_join):
        assert join(a, ["k"], b, ["k"]).count() == 50 + 25 + 25 and join(a, ["k"], b, ["k"], "both").count() == 105
