"""The engine's own queries over the driver's tables, with their SQL for DuckDB.

Every query runs over whole tables.  Sums are of decimals, so that they don't
depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relplan.functions import expressions as E
from relplan.operators import aggregates as A
from relplan.operators import joins as J
from relplan.operators import relational as R
from relplan.sources import datasets as D
from relplan.sources import shared
from relplan.sources.tables import Database, Snapshot, can_vacuum
from relplan.streaming import files as S

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None, name: str | None = None):
    def register(f: Query) -> Query:
        _FOUND[name or f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}


def _plain(df: DataFrame) -> DataFrame:
    """Sums, which are decimals of 30 digits, as 64 bits: all of them fit here."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() == "decimal(30,0)" else F.col(f.name) for f in df.schema])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- flagship ---------------------------------------------------------------


@query("""SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,4))) AS DOUBLE) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of returned lines by nation, the ten highest: selection, hash joins, hash aggregation, top-k."""
    lines = R.selection(table(spark, sf_dir, "lineitem"), "l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    placed = J.equi_join(customers, ["c_nationkey"], nations, ["n_nationkey"]).select("left.c_custkey", "right.n_name")
    known = J.equi_join(orders, ["o_custkey"], placed, ["c_custkey"]).select("left.o_orderkey", "right.n_name")
    sold = J.equi_join(lines, ["l_orderkey"], known, ["o_orderkey"]).select("right.n_name", (F.col("left.l_extendedprice") * (1 - F.col("left.l_discount"))).cast("decimal(38,4)").alias("revenue"))
    grouped = sold.groupBy("n_name").agg(F.sum("revenue").cast("double").alias("revenue"), F.count("*").alias("lines"))
    return grouped.orderBy(F.desc("revenue"), "n_name").limit(10)


# -- sources and sinks ------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'one'), (2, NULL), (CAST(NULL AS BIGINT), 'none')) t(k, v)")
def constant_data(spark, sf_dir):
    return D.constant(spark, [(1, "one"), (2, None), (None, "none")], "k long, v string")


@query("SELECT CAST(range AS BIGINT) AS num, CAST(CASE WHEN range % 2 = 1 THEN -range ELSE range END AS DOUBLE) AS some_numeric, CASE WHEN range % 3 <> 0 THEN 'value' END AS value_in_string FROM range(100000)")
def generator(spark, sf_dir):
    return D.records(spark, 100_000).select("num", F.col("some_numeric").cast("double").alias("some_numeric"), "value_in_string")


@query("SELECT range * 10 + i AS n, (range * 10 + i) * (range * 10 + i) AS square FROM range(4), (SELECT unnest(range(10)) AS i)")
def generator_function(spark, sf_dir):
    return D.generator(spark, lambda part: ((part * 10 + i, (part * 10 + i) ** 2) for i in range(10)), "n long, square long", parts=4)


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_round_trip(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = shared.new_path(spark, "stream")
    D.stream_output(events, path)
    return D.stream_input(spark, path, events.schema)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 50")
def structured_stream(spark, sf_dir):
    """A selection over the file stream, drained into files."""
    events = table(spark, sf_dir, "events")
    source, path, checkpoint = (shared.new_path(spark, x) for x in ("source", "sink", "checkpoint"))
    events.write.parquet(source)
    chosen = R.selection(S.stream(spark, source, events.schema), "value > 50.0").select("event_id", "user_id", "event_type", "value")
    S.drain(chosen, path, checkpoint)
    return spark.read.schema(chosen.schema).parquet(path)


@query("SELECT * FROM nation")
def identity(spark, sf_dir):
    return R.identity(table(spark, sf_dir, "nation"))


# -- filters, projections, transformers -------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 30 AND l_discount BETWEEN 0.02 AND 0.05")
def selection(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "lineitem"), "l_quantity > 30e0 AND l_discount BETWEEN 2e-2 AND 5e-2").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey AS proj_0, o_orderkey // 7 AS proj_1, o_orderstatus || '-' || o_orderpriority AS proj_2, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS proj_3 FROM orders")
def projection(spark, sf_dir):
    return R.projection(table(spark, sf_dir, "orders"), [0, "o_orderkey / 7", "o_orderstatus || '-' || o_orderpriority", "CASE WHEN o_totalprice > 1e5 THEN 1 ELSE 0 END"])


@query("SELECT vec_id AS id, embedding[1] AS first, embedding[3] AS third, CAST(NULL AS FLOAT) AS beyond FROM embeddings")
def simple_projection(spark, sf_dir):
    return R.transformed(table(spark, sf_dir, "embeddings"), R.simple_projection("vectors", [0, (1, 0), (1, 2), (1, 100_000)], ["id", "first", "third", "beyond"]))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) + 6 AS row_number, o_orderkey FROM orders")
def row_number(spark, sf_dir):
    numbered = R.transformed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), R.row_number(["o_totalprice", "o_orderkey"], [False, True], start=7))
    return numbered.select("row_number", "row.o_orderkey")


@query("SELECT 777 AS row_identifier, p_partkey, p_name FROM part")
def row_identifier(spark, sf_dir):
    return R.transformed(table(spark, sf_dir, "part"), R.row_identifier(777)).select("row_identifier", "row.p_partkey", "row.p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 5 <> 0 AND 100 // (p_size % 5) > 30")
def selection_dropping_errors(spark, sf_dir):
    """Rows where the divisor is zero are dropped, not failed."""
    return R.transformed(table(spark, sf_dir, "part"), R.selection_dropping_errors("100 / (p_size % 5) > 30")).select("p_partkey", "p_size")


@query("SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def user_transformer(spark, sf_dir):
    return R.transformed(table(spark, sf_dir, "supplier"), R.mapped(lambda df: df.select("s_suppkey", F.upper("s_name").alias("s_name"))))


# -- joins ------------------------------------------------------------------

_BAND = "SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a {how} JOIN part b ON abs(a.p_partkey - b.p_partkey) <= 3"


def _parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return part, part


def _pairs(joined):
    return joined.select(F.col("left.p_partkey").alias("left_key"), F.col("right.p_partkey").alias("right_key"))


@query(_BAND.format(how=""))
def band_join(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return _pairs(J.band_join(a, "p_partkey", b, "p_partkey", 3))


@query("SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a LEFT JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey <= a.s_suppkey + 3 AND a.s_nationkey <> b.s_nationkey")
def nested_loop_left(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    on = "a.s_suppkey < b.s_suppkey AND b.s_suppkey <= a.s_suppkey + 3 AND a.s_nationkey <> b.s_nationkey"
    return J.nested_loop_join(supplier, supplier, on, "left", ("a", "b")).select(F.col("left.s_suppkey").alias("left_key"), F.col("right.s_suppkey").alias("right_key"))


@query("SELECT r_name AS left_r_name, n_name AS right_n_name FROM region CROSS JOIN nation")
def nested_loop_cross(spark, sf_dir):
    return J.flat(J.nested_loop_join(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), None))


_SIDES = """WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 100 END AS k FROM customer),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_orderkey % 1000 END AS k FROM orders)
"""


def _sides(spark, sf_dir):
    """Keys with nulls and repetitions on both sides, and some without a partner."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 100).alias("k"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 500 != 0, F.col("o_orderkey") % 1000).alias("k"))
    return left, right


for _how, _sql in (("none", ""), ("left", "LEFT"), ("right", "RIGHT"), ("both", "FULL")):
    for _join in (J.sort_merge_join, J.hash_join):
        query(f"{_SIDES} SELECT l.id AS left_id, l.k AS left_k, r.id AS right_id, r.k AS right_k FROM l {_sql} JOIN r ON l.k IS NOT DISTINCT FROM r.k", f"{_join.__name__}_{_how}")(
            lambda spark, sf_dir, join=_join, how=_how: J.flat(join((s := _sides(spark, sf_dir))[0], ["k"], s[1], ["k"], how))
        )
for _kind, _sql in (("semi", ""), ("anti", "NOT")):
    for _semi in (J.sort_merge_semi_join, J.hash_semi_join):
        query(f"{_SIDES} SELECT id, k FROM l WHERE {_sql} EXISTS (SELECT 1 FROM r WHERE l.k IS NOT DISTINCT FROM r.k)", f"{_semi.__name__.replace('_semi_join', '')}_{_kind}_join")(
            lambda spark, sf_dir, join=_semi, kind=_kind: join((s := _sides(spark, sf_dir))[0], ["k"], s[1], ["k"], kind)
        )
    query(f"{_SIDES} SELECT id, k FROM l WHERE {_sql} EXISTS (SELECT 1 FROM r WHERE l.k = r.k)", f"nested_loop_{_kind}_join")(
        lambda spark, sf_dir, kind=_kind: J.nested_loop_semi_join(*_sides(spark, sf_dir), "l.k = r.k", kind, ("l", "r"))
    )


_THETA = "SELECT s_suppkey, s_acctbal FROM supplier s WHERE {how} EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey < s.s_nationkey AND c.c_acctbal > s.s_acctbal + 9000)"
for _kind, _sql in (("semi", ""), ("anti", "NOT")):
    query(_THETA.format(how=_sql), f"theta_{_kind}_join")(
        lambda spark, sf_dir, kind=_kind: J.nested_loop_semi_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), "c.c_nationkey < s.s_nationkey AND c.c_acctbal > s.s_acctbal + 9000", kind, ("s", "c")).select("s_suppkey", "s_acctbal")
    )


@query("SELECT s_suppkey AS left_key, n_nationkey AS right_key FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_suppkey % 5 <> n_regionkey")
def theta_join_in_blocks(spark, sf_dir):
    """The way of sides too large to broadcast, block by block."""
    a, b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    on = F.expr("left.s_nationkey < right.n_nationkey AND left.s_suppkey % 5 <> right.n_regionkey")
    return J._in_blocks(J.wrapped(a, "left"), J.wrapped(b, "right"), on, "inner", block_bytes=256).select(F.col("left.s_suppkey").alias("left_key"), F.col("right.n_nationkey").alias("right_key"))


# -- aggregation ------------------------------------------------------------


@query("SELECT count(*) AS agg_0, count(quality) AS agg_1, min(text) AS agg_2, max(text) AS agg_3, CAST(sum(d.doc_id) AS BIGINT) AS agg_4 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def simple_aggregation(spark, sf_dir):
    joined = J.flat(J.equi_join(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"], "left"))
    return _plain(A.simple_aggregation(joined, [("count", "*"), ("count", "right_quality"), ("min", "left_text"), ("max", "left_text"), ("sum", "left_doc_id")]))


@query("SELECT count(*) AS agg_0, min(n_name) AS agg_1, CAST(sum(n_nationkey) AS BIGINT) AS agg_2 FROM nation WHERE n_nationkey < 0")
def simple_aggregation_empty(spark, sf_dir):
    return _plain(A.simple_aggregation(R.selection(table(spark, sf_dir, "nation"), "n_nationkey < 0"), [("count", "*"), ("min", "n_name"), ("sum", "n_nationkey")]))


_GROUPED = "SELECT l_returnflag AS key_0, l_linestatus AS key_1, count(*) AS agg_0, count(l_shipdate) AS agg_1, min(l_orderkey) AS agg_2, max(l_orderkey) AS agg_3, CAST(sum(l_partkey) AS BIGINT) AS agg_4 FROM lineitem GROUP BY ALL"


@query(_GROUPED)
def hash_aggregation(spark, sf_dir):
    return _plain(A.hash_aggregation(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("count", "*"), ("count", "l_shipdate"), ("min", "l_orderkey"), ("max", "l_orderkey"), ("sum", "l_partkey")]))


@query(_GROUPED)
def sorted_aggregation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _plain(A.sorted_aggregation(lines, ["l_returnflag", "l_linestatus"], [("count", "*"), ("count", "l_shipdate"), ("min", "l_orderkey"), ("max", "l_orderkey"), ("sum", "l_partkey")]))


@query("SELECT DISTINCT o_orderstatus AS key_0, o_orderpriority AS key_1 FROM orders")
def hash_aggregation_distinct(spark, sf_dir):
    return A.hash_aggregation(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id AS key_0, event_type AS key_1, count(*) AS agg_0, min(event_id) AS agg_1 FROM r GROUP BY user_id, event_type, run""")
def runs_aggregation(spark, sf_dir):
    """One row for each run of equal event types of a user."""
    return A.sorted_aggregation(table(spark, sf_dir, "events"), ["user_id", "event_type"], [("count", "*"), ("min", "event_id")], order=["event_id"], within=["user_id"])


@query("""SELECT o_orderstatus AS key_0, first(o_totalprice ORDER BY o_totalprice, o_orderkey) AS low_price, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS low_key,
first(o_totalprice ORDER BY o_totalprice DESC, o_orderkey DESC) AS high_price, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS high_key FROM orders GROUP BY 1""")
def minmax_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.struct("o_totalprice", "o_orderkey").alias("pair"))
    out = A.hash_aggregation(rows, ["o_orderstatus"], [("min", "pair"), ("max", "pair")])
    return out.select("key_0", F.col("agg_0.o_totalprice").alias("low_price"), F.col("agg_0.o_orderkey").alias("low_key"), F.col("agg_1.o_totalprice").alias("high_price"), F.col("agg_1.o_orderkey").alias("high_key"))


@query("SELECT label AS key_0, min(embedding)[1] AS low, max(embedding)[1] AS high FROM embeddings GROUP BY 1")
def minmax_array(spark, sf_dir):
    out = A.hash_aggregation(table(spark, sf_dir, "embeddings"), ["label"], [("min", "embedding"), ("max", "embedding")])
    return out.select("key_0", F.get("agg_0", F.lit(0)).alias("low"), F.get("agg_1", F.lit(0)).alias("high"))


@query("SELECT c_nationkey AS key_0, CAST(max(c_custkey) - min(c_custkey) AS BIGINT) AS agg_0 FROM customer GROUP BY 1")
def user_aggregate(spark, sf_dir):
    """An aggregate of the user's, as a function of columns."""
    return A.hash_aggregation(table(spark, sf_dir, "customer"), ["c_nationkey"], [(lambda c: F.max(c) - F.min(c), "c_custkey")])


@query("""WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT event_type AS key_0, count(*) AS agg_0, min(event_id) AS agg_1 FROM r GROUP BY event_type, run""")
def runs_over_all_rows(spark, sf_dir):
    """One row for each run of equal event types over the whole table."""
    return A.sorted_aggregation(table(spark, sf_dir, "events"), ["event_type"], [("count", "*"), ("min", "event_id")], order=["event_id"])


# -- sort, limit, unions ----------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 100")
def sort_topk(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [False, True], first=100)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def sort_all(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST OFFSET 55 LIMIT 155")
def offset_limit(spark, sf_dir):
    return R.offset_limit(R.sort(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]), 55, 155)


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100)")
def offset_alone(spark, sf_dir):
    return R.offset_limit(R.sort(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]), 100)


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf_dir):
    return R.union([table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")])


@query("SELECT range AS n FROM range(300000)")
def merge_sorted(spark, sf_dir):
    """Thirty inputs, of which the ith has i, i + 30, i + 60 ..."""
    return R.merge_sorted([spark.range(i, 300_000, 30).select(F.col("id").alias("n")) for i in range(30)], ["n"])


@query("SELECT true AS matched, count(*) AS left_rows, count(*) AS right_rows, CAST(NULL AS BIGINT) AS first_mismatch FROM orders JOIN customer ON o_custkey = c_custkey")
def result_match(spark, sf_dir):
    """Merge and hash join of the same inputs, compared row by row."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    one, two = (J.flat(join(orders, ["o_custkey"], customer, ["c_custkey"])) for join in (J.sort_merge_join, J.hash_join))
    return R.match(one, two, ["left_o_orderkey"])


# -- expressions ------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey * 3 - l_suppkey AS a, l_orderkey // 7 AS b, (l_suppkey - l_partkey) // 7 AS c, (l_suppkey - l_partkey) % 7 AS d, l_quantity / 4 AS e, -l_orderkey AS f FROM lineitem""")
def expr_arith(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    texts = ["l_partkey * 3 - l_suppkey", "l_orderkey / 7", "(l_suppkey - l_partkey) / 7", "(l_suppkey - l_partkey) % 7", "l_quantity / 4", "-l_orderkey"]
    return R.projection(lines, [0, 3, *texts]).toDF("l_orderkey", "l_linenumber", *"abcdef")


@query("SELECT o_orderkey, o_orderkey & o_custkey AS a, o_orderkey | o_custkey AS b, xor(o_orderkey, o_custkey) AS c, ~o_orderkey AS d, o_orderkey << 3 AS e, o_orderkey >> 2 AS f FROM orders")
def expr_bits(spark, sf_dir):
    texts = ["o_orderkey & o_custkey", "o_orderkey | o_custkey", "o_orderkey ^ o_custkey", "~o_orderkey", "o_orderkey << 3", "o_orderkey >> 2"]
    return R.projection(table(spark, sf_dir, "orders"), [0, *texts]).toDF("o_orderkey", *"abcdef")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' OR p_type NOT LIKE 'S%'")
def expr_like(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "part"), "p_name LIKE '%1_' OR p_type NOT LIKE 'S%'").select("p_partkey", "p_name")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderkey AS DOUBLE) AS b, CAST(o_orderkey AS INT) + 1 AS c, CAST('193900' AS BIGINT) AS d FROM orders")
def expr_cast(spark, sf_dir):
    return R.projection(table(spark, sf_dir, "orders"), [0, "CAST(o_orderkey AS VARCHAR(20))", "CAST(o_orderkey AS DOUBLE)", "CAST(CAST(o_orderkey AS TEXT) AS INT) + 1", "CAST('1.939e5' AS BIGINT)"]).toDF("o_orderkey", *"abcd")


@query("SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unknown' END AS a, l.quality IS NULL AS b, l.quality = 1 AND d.lang = 'en' AS c, d.lang IN ('en', 'de') AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def expr_case(spark, sf_dir):
    joined = J.equi_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"], "left")
    texts = ["left.doc_id", "CASE right.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unknown' END", "right.quality IS NULL", "right.quality = 1 AND left.lang = 'en'", "left.lang IN ('en', 'de')"]
    return R.projection(joined, texts).toDF("doc_id", *"abcd")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber = 1 THEN false ELSE 100 // (l_linenumber - 1) > 20 END")
def expr_division_by_zero(spark, sf_dir):
    """Rows on which the division fails are dropped."""
    return R.selection_dropping_errors("100 / (l_linenumber - 1) > 20")(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) + 1 AS DOUBLE) AS a, CAST(o_orderkey AS DOUBLE) / 8 AS b FROM orders")
def expr_numeric(spark, sf_dir):
    """Casts to NUMERIC keep what two decimals hold."""
    return R.projection(table(spark, sf_dir, "orders"), [0, "CAST(CAST(o_totalprice AS NUMERIC) + 1 AS DOUBLE)", "CAST(CAST(o_orderkey AS NUMERIC) AS DOUBLE) / 8"]).toDF("o_orderkey", *"ab")


@query("SELECT text, kind FROM (VALUES ('nothing_like_it + 1', 'UnknownVariable'), ('l_quantity < l_returnflag', 'Incomparable'), ('sqrt(l_quantity)', 'ExpressionError')) t(text, kind)")
def expr_refused(spark, sf_dir):
    """Expressions that are refused when read, and the class of the error."""
    scope, out = R.scope(table(spark, sf_dir, "lineitem")), []
    for text in ("nothing_like_it + 1", "l_quantity < l_returnflag", "sqrt(l_quantity)"):
        try:
            E.read(text, scope)
        except E.ExpressionError as e:
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "text string, kind string")


# -- tables -----------------------------------------------------------------


def _database(spark) -> Database:
    return Database(spark, shared.new_path(spark, "db"))


def _filled(spark, sf_dir) -> Database:
    """A table of all orders, with one partition for each half of the keys."""
    db = _database(spark)
    db.create_table("orders", key="BIGINT", status="TEXT", price="DOUBLE")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS status", "o_totalprice AS price")
    tx = db.begin()
    tx.insert("orders", orders.where("key % 2 = 0"))
    tx.commit()
    db.new_partition("orders")
    tx = db.begin()
    tx.insert("orders", orders.where("key % 2 = 1"))
    tx.commit()
    return db


@query("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0")
def table_scan_delete(spark, sf_dir):
    """Insert, delete, and scan; changes that aborted or aren't committed stay invisible."""
    db = _filled(spark, sf_dir)
    tx = db.begin()
    tx.delete("orders", R.selection(tx.scan("orders", pointers=True), "key % 3 = 0"))
    tx.commit()
    lost, open_ = db.begin(), db.begin()
    lost.insert("orders", lost.scan("orders"))
    lost.abort()
    open_.delete("orders", open_.scan("orders", pointers=True))
    return db.begin().scan("orders").select("key", "status")


@query("SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders")
def table_snapshot(spark, sf_dir):
    """A transaction goes on seeing what was there when it began."""
    db = _filled(spark, sf_dir)
    reader, writer = db.begin(), db.begin()
    writer.delete("orders", writer.scan("orders", pointers=True))
    writer.commit()
    return reader.scan("orders")


@query("SELECT o_orderkey AS key, o_totalprice AS price FROM orders WHERE o_orderkey % 10 = 1")
def table_lookup(spark, sf_dir):
    db = _filled(spark, sf_dir)
    tx = db.begin()
    pointers = R.selection(tx.scan("orders", pointers=True), "key % 10 = 1").select("partition_id", "tuple_pointer")
    return tx.lookup("orders", shared.keep(pointers, "pointers")).select("key", "price")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT -n_nationkey, 'new', n_name FROM nation")
def table_schema_change(spark, sf_dir):
    """Columns added, dropped and renamed; older rows are read under the newest schema."""
    db = _filled(spark, sf_dir)
    db.add_column("orders", "note", "TEXT")
    db.drop_column("orders", "price")
    db.rename_column("orders", "key", "id")
    tx = db.begin()
    tx.insert("orders", table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).alias("id"), F.lit("new").alias("status"), F.col("n_name").alias("note")))
    tx.commit()
    return db.begin().scan("orders")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def table_update(spark, sf_dir):
    db = _filled(spark, sf_dir)
    tx = db.begin()
    tx.update("orders", "key % 5 = 0", status="'X'")
    tx.commit()
    return db.begin().scan("orders").select("key", "status")


@query("SELECT r_regionkey, r_name FROM region")
def consumer(spark, sf_dir):
    """A consumer takes every row, one after another."""
    taken = []
    D.consume(R.sort(table(spark, sf_dir, "region"), ["r_regionkey"]), lambda row: taken.append((row.r_regionkey, row.r_name)))
    return spark.createDataFrame(taken, "r_regionkey int, r_name string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def clone_transformer(spark, sf_dir):
    """A clone of a row is the row: rows don't change."""
    return R.transformed(table(spark, sf_dir, "nation"), R.identity, lambda df: R.selection(df, "n_regionkey < 3")).select("n_nationkey", "n_name")


_VERSIONS = "SELECT event_id, event_id % 13 AS xmin, CASE WHEN user_id % 3 = 0 THEN user_id % 11 END AS xmax FROM events"


@query(f"""SELECT event_id, CASE WHEN NOT seen OR (xmax IS NOT NULL AND gone) THEN 'invisible' WHEN xmax IS NULL THEN 'can_delete' WHEN xmax = 10 THEN 'wait' ELSE 'must_abort' END AS may,
xmax IS NOT NULL AND xmax < 4 AND xmax <> 2 AS vacuum
FROM (SELECT *, xmin = 9 OR (xmin < 8 AND xmin NOT IN (3, 5)) AS seen, xmax = 9 OR (xmax < 8 AND xmax NOT IN (3, 5)) AS gone FROM ({_VERSIONS}))""")
def mvcc_rules(spark, sf_dir):
    """What a snapshot sees of row versions, and what may be deleted or vacuumed."""
    snapshot = Snapshot(9, 8, (3, 5), 0)
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 13 AS xmin", "CASE WHEN user_id % 3 = 0 THEN user_id % 11 END AS xmax")
    return rows.select("event_id", snapshot.can_delete(F.col("xmin"), F.col("xmax"), (10,)).alias("may"), F.coalesce(can_vacuum(F.col("xmax"), 4, F.col("xmax") != 2), F.lit(False)).alias("vacuum"))


@query(f"SELECT event_id FROM ({_VERSIONS}) WHERE (xmin = 9 OR (xmin < 8 AND xmin NOT IN (3, 5))) AND (xmax IS NULL OR NOT (xmax = 9 OR (xmax < 8 AND xmax NOT IN (3, 5))))")
def mvcc_transformer(spark, sf_dir):
    """Readability of row versions as a transformer."""
    snapshot = Snapshot(9, 8, (3, 5), 0)
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 13 AS xmin", "CASE WHEN user_id % 3 = 0 THEN user_id % 11 END AS xmax")
    return R.transformed(rows, lambda df: df.where(snapshot.visible(F.col("xmin"), F.col("xmax")))).select("event_id")


@query("SELECT thing, name, kind FROM (VALUES ('table', 'sales', '2'), ('column', 'id', 'BIGINT'), ('column', 'note', 'TEXT'), ('index', 'by_id', 'hash'), ('status', '1', 'committed'), ('status', '2', 'aborted'), ('status', '3', 'in_progress'), ('status', '9', 'unassigned'), ('horizon', '3', '')) t(thing, name, kind)")
def table_catalogue(spark, sf_dir):
    """Tables renamed and dropped, indices, getters, transactions and the horizon."""
    db = _database(spark)
    db.create_table("orders", id="BIGINT")
    db.create_table("lost", id="BIGINT")
    db.add_column("orders", "note", "TEXT")
    db.rename_table("orders", "sales")
    db.drop_table("lost")
    db.create_index("sales", "old", "id", "hash")
    db.create_index("sales", "gone", "note")
    db.rename_index("sales", "old", "by_id")
    db.drop_index("sales", "gone")
    one, two, _ = db.begin(), db.begin(), db.begin()
    one.commit()
    two.abort()
    out = [("table", t, str(len(db.partitions(t)))) for t in db.tables()]
    out += [("column", a["name"], a["type"]) for a in db.attributes("sales")] + [("index", i["name"], i["kind"]) for i in db.indices("sales")]
    out += [("status", str(i), db.status(i)) for i in (1, 2, 3, 9)] + [("horizon", str(db.horizon()), "")]
    return spark.createDataFrame(out, "thing string, name string, kind string")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def table_own_rows(spark, sf_dir):
    """A statement that reads the table it fills doesn't see its own rows; the transaction does afterwards."""
    db = _database(spark)
    db.create_table("nations", key="INT", name="TEXT")
    tx = db.begin()
    tx.insert("nations", table(spark, sf_dir, "nation").selectExpr("n_nationkey AS key", "n_name AS name"))
    tx.insert("nations", tx.scan("nations"))
    return tx.scan("nations")
