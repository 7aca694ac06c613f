import math

import pytest

from relplan.operators import aggregates as A
from relplan.operators import joins as J
from relplan.operators import relational as R
from relplan.sources import datasets as D
from relplan.streaming import files as S

NULLS = [(1, "a"), (None, "b"), (None, "c"), (3, "d")]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(NULLS, "k long, v string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("preserve", list(J.PRESERVE))
def test_merge_and_hash_join_agree_and_nulls_meet(spark, keys, preserve):
    other = spark.createDataFrame([(None, 10), (3, 30), (3, 31), (9, 90)], "k long, w long")
    one, two = (J.flat(join(keys, ["k"], other, ["k"], preserve)) for join in (J.sort_merge_join, J.hash_join))
    assert rows(one) == rows(two)
    assert R.match(one, two).first().matched
    assert len(rows(one)) == {"none": 4, "left": 5, "right": 5, "both": 6}[preserve]


def test_the_missing_side_is_a_null_tuple(spark, keys):
    other = spark.createDataFrame([(9,)], "k long")
    assert all(r.right is None for r in J.sort_merge_join(keys, ["k"], other, ["k"], "left").collect())


def test_three_join_algorithms_on_a_self_join(spark):
    df = D.records(spark, 60).select("num", "num_in_words")
    three = [J.flat(J.nested_loop_join(df, df, "left.num_in_words = right.num_in_words")), J.flat(J.sort_merge_join(df, [1], df, [1])), J.flat(J.hash_join(df, [1], df, [1]))]
    assert rows(three[0]) == rows(three[1]) == rows(three[2])


@pytest.mark.parametrize(("kind", "wanted"), [("semi", ["b", "c"]), ("anti", ["a", "d"])])
def test_semi_joins_on_keys_are_null_safe(spark, keys, kind, wanted):
    right = spark.createDataFrame([(None,)], "k long")
    for join in (J.sort_merge_semi_join, J.hash_semi_join):
        assert [r.v for r in join(keys, ["k"], right, ["k"], kind).orderBy("v").collect()] == wanted
    assert J.nested_loop_semi_join(keys, right, "left.k = right.k", kind).count() == {"semi": 0, "anti": 4}[kind]


def test_semi_join_without_expression(spark, keys):
    empty = keys.where("false")
    assert J.nested_loop_semi_join(keys, keys, None).count() == 4 and J.nested_loop_semi_join(keys, empty, None).count() == 0
    assert J.nested_loop_semi_join(keys, empty, None, "anti").count() == 4


def test_nested_loop_join_refuses_right(keys):
    with pytest.raises(ValueError):
        J.nested_loop_join(keys, keys, "left.k = right.k", "right")


@pytest.mark.parametrize("width", [0, 1, 3])
def test_band_join_equals_nested_loop(spark, width):
    a, b = spark.createDataFrame([(i,) for i in range(-20, 20, 3)] + [(None,)], "x long"), spark.createDataFrame([(i,) for i in range(-9, 30)], "y long")
    theta = f"CASE WHEN x >= y THEN x - y ELSE y - x END <= {width}"
    for preserve in ("none", "left"):
        assert rows(J.flat(J.band_join(a, "x", b, "y", width, preserve))) == rows(J.flat(J.nested_loop_join(a, b, theta, preserve)))


def test_aggregates(spark, keys):
    assert A.simple_aggregation(keys, [("count", "*"), ("count", "k"), ("sum", "k"), ("min", "v"), ("max", "*")]).first()[:4] == (4, 2, 4, "a")
    assert A.simple_aggregation(keys.where("false"), [("count", "*"), ("sum", "k")]).collect() == [(0, None)]
    assert rows(A.hash_aggregation(keys, ["k"], [("count", "*")])) == sorted([(1, 1), (None, 2), (3, 1)], key=str)
    assert A.hash_aggregation(keys, ["k"]).count() == 3
    assert A.hash_aggregation(keys.where("false"), ["k"], [("count", "*")]).count() == 0
    with pytest.raises(ValueError):
        A.simple_aggregation(keys, [])
    with pytest.raises(TypeError):
        A.simple_aggregation(keys, [("sum", "v")])


def test_sum_of_large_integers_does_not_overflow(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "x long")
    assert int(A.simple_aggregation(df, [("sum", "x")]).first()[0]) == 2**64 - 2


def test_min_and_max_of_nested_values_and_nan(spark):
    df = spark.createDataFrame([([1],), ([1, 0],), (None,)], "a array<int>")
    assert A.simple_aggregation(df, [("min", "a"), ("max", "a")]).first()[:] == ([1], [1, 0])
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "d double")
    assert math.isnan(A.simple_aggregation(nan, [("max", "d")]).first()[0])


def test_runs_and_user_aggregates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "i long, c string")
    assert rows(A.sorted_aggregation(df, ["c"], [("count", "*")], order=["i"])) == [("x", 1), ("x", 2), ("y", 1)]
    largest = A.pandas_aggregate(lambda s: float(s.max()), "double")
    assert rows(A.hash_aggregation(df, ["c"], [(largest, "i")])) == [("x", 4.0), ("y", 3.0)]


def test_sort_puts_null_lowest(keys):
    assert [r.k for r in R.sort(keys, ["k", "v"]).collect()] == [None, None, 1, 3]
    assert [r.k for r in R.sort(keys, ["k", "v"], [False, True]).collect()] == [3, 1, None, None]
    assert [r.v for r in R.sort(keys, ["v"], first=2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        R.sort(keys, ["k"], first=0)


def test_offset_limit(spark):
    df = R.sort(spark.range(100), ["id"])
    assert [r.id for r in R.offset_limit(df, 55, 3).collect()] == [55, 56, 57]
    with pytest.raises(ValueError):
        R.offset_limit(df, 0, 0)


def test_union_needs_equal_types_and_merge_sorts(spark):
    parts = [spark.range(i, 100, 3) for i in range(3)]
    assert [r.id for r in R.merge_sorted(parts, ["id"]).collect()] == list(range(100))
    with pytest.raises(TypeError):
        R.union([spark.range(1), spark.range(1).selectExpr("cast(id as int) as id")])


def test_row_numbers_have_no_gaps(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(50)] + [(None,)], "x long")
    found = R.row_number(["x"], start=7)(df).orderBy("row_number").collect()
    assert [r.row_number for r in found] == list(range(7, 58))
    assert [r.row.x for r in found] == [None] + sorted(i % 3 for i in range(50))


def test_transformers(spark, keys):
    out = R.transformed(keys, R.simple_projection("t", ["v", 0], ["a", "b"]), R.row_identifier(7), R.identity, R.mapped(lambda it: (d.assign(row_identifier=d.row_identifier + 1)[["row_identifier"]] for d in it), "row_identifier long"))
    assert {r.row_identifier for r in out.collect()} == {8}
    assert R.projection(keys, [0, (1,), "*"]).columns == ["proj_0", "proj_1", "proj_2"]


def test_match_finds_the_first_difference(spark):
    a, b = spark.range(10), spark.range(10).selectExpr("CASE WHEN id = 6 THEN 60 ELSE id END AS x")
    assert R.match(a, a, ["id"]).first()[:] == (True, 10, 10, None)
    found = R.match(a, b, [0]).first()
    assert not found.matched and found.first_mismatch == 6
    assert not R.match(a, a.limit(9)).first().matched


def test_consumer_stops_early(spark):
    seen = []
    assert D.consume(spark.range(100).coalesce(1), lambda r: seen.append(r.id) or len(seen) < 5) == 5


def test_records(spark):
    found = {r.num: r for r in D.records(spark, 1200).collect()}
    assert found[0].num_in_words == "zero" and found[1115].num_in_words == "one hundred fifteen" and found[21].num_in_words == "twenty one"
    assert found[0].digits == [] and found[120].digits == [0, 2, 1] and found[3].value_in_string is None and found[3].some_numeric == -3


def test_streams(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(10).write.parquet(source)
    for more in (0, 1):
        if more:
            spark.range(10, 15).write.mode("append").parquet(source)
        S.drain(R.selection(S.stream(spark, source, "id long"), "id % 2 = 0"), sink, check)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
    sizes = []
    S.each_batch(S.stream(spark, source, "id long", files_per_batch=1), lambda df, i: sizes.append(df.count()), str(tmp_path / "check2"))
    assert sum(sizes) == 15 and len(sizes) > 1
    with pytest.raises(Exception, match="."):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "x.json").write_text('{"id": ')
        D.stream_input(spark, str(tmp_path / "bad"), "id long", "json").collect()
