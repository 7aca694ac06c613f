import pytest
from pyspark.errors import PySparkException

from relplan.functions import expressions as E
from relplan.functions import types
from relplan.operators import relational as R


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(7, -7, 2, 1.5, "abc", None, True, [5, 6], ("x", 3))], "a long, m long, b int, d double, s string, n long, t boolean, arr array<int>, st struct<x:string,y:int>").alias("one")


def value(df, text, table="one"):
    return R.projection(df, [text] if isinstance(text, str) else text, table).first()[0]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("a / b", 3), ("m / b", -3), ("m % b", -1), ("a * b - 1", 13), ("d / 2", 0.75), ("-a", -7), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9),
        ("a & 3", 3), ("a | 8", 15), ("a ^ 1", 6), ("~a", -8), ("1 << 65", 2), ("m >> 1", -4),
        ("s || '-x'", "abc-x"), ("s LIKE 'a%'", True), ("s LIKE '_b_'", True), ("'a%' LIKE 'a\\%'", False), ("s NOT LIKE 'b%'", True),
        ("n IS NULL", True), ("n = 1", None), ("n = 1 OR TRUE", True), ("NOT n", None), ("a BETWEEN 1 AND 7", True), ("a IN (1, 7)", True), ("a NOT IN (1, 2)", True),
        ("CASE WHEN a THEN 'y' ELSE 'z' END", "y"), ("CASE a WHEN 7 THEN 1 WHEN 8 THEN 2 END", 1), ("NOT s", False), ("'' OR 0", False),
        ("CAST('1.939e5' AS BIGINT)", 193900), ("CAST(a AS SMALLINT)", 7), ("CAST(1e10 AS TEXT)", "10000000000"), ("CAST(s AS VARCHAR(2))", "abc"), ("CAST(2 AS BIGINT(16, UNSIGNED))", 2),
        ("arr.1", 6), ("one.arr.9", None), ("st.y + 1", 4), ("one.st.x", "x"), ("1e2", 100.0), ("t AND 1", True), ("a <> 7", False), ("it''s IS NULL" if False else "'it''s'", "it's"),
    ],
)
def test_values(one, text, wanted):
    assert value(one, text) == wanted


@pytest.mark.parametrize("text", ["a / 0", "a % 0", "d / 0", "CAST(1.5 AS INT)", "CAST('x' AS INT)", "CAST(300 AS INT(1))", "CAST(m AS INT(4, UNSIGNED))"])
def test_failures_of_values(one, text):
    with pytest.raises(PySparkException):
        value(one, text)


@pytest.mark.parametrize(("text", "error"), [("zzz", E.UnknownVariable), ("s = a", E.Incomparable), ("st", None), ("s + 1", E.Incomparable), ("d & 1", E.ExpressionError), ("f(a)", E.ExpressionError), ("a +", E.ExpressionError), ("a b", E.ExpressionError), ("CASE WHEN t THEN 1 ELSE 'x' END", E.Incomparable), ("st = st", E.Incomparable), ("CAST(a AS DATE)", TypeError)])
def test_refusals(one, text, error):
    if error is None:
        assert value(one, text).x == "x"
    else:
        with pytest.raises(error):
            value(one, text)


def test_ambiguity(spark):
    df = spark.range(1)
    scope = E.Scope([("l", df.schema, None), ("r", df.schema, None)])
    with pytest.raises(E.AmbiguousVariable):
        E.read("id", scope)
    assert E.read("l.id", scope).kind.simpleString() == "bigint"


def test_decimal_literals_keep_their_digits(one):
    assert str(value(one, "1.25 + 2")) == "3.25"


def test_selection_fails_where_the_transformer_drops(spark):
    df = spark.createDataFrame([(0,), (5,), (None,)], "x long")
    with pytest.raises(PySparkException):
        R.selection(df, "10 / x > 1").collect()
    assert [r.x for r in R.transformed(df, R.selection_dropping_errors("10 / x > 1")).collect()] == [5]


def test_types():
    assert types.parse("UINT[1]")[0].simpleString() == "smallint"
    assert types.parse("UINT[8]")[0].simpleString() == "decimal(20,0)"
    assert types.parse("ARRAY[INT[2]]")[0].simpleString() == "array<smallint>"
    assert types.bounds(*types.parse("INT[2]")) == (-32768, 32767)
    with pytest.raises(TypeError):
        types.parse("DATE")
