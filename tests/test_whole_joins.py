"""The joins over whole tables against brute force: every order of the input can find its partner."""

from relplan.plans import catalogue

JOINS = {"band_join", *(f"{a}_{b}_join" for a in ("sort_merge", "hash", "nested_loop") for b in ("semi", "anti"))}


def test_whole_joins_against_brute_force(spark, tmp_path):
    customers, orders, parts = range(1, 120), range(1, 1100), range(1, 12)
    spark.createDataFrame([(i,) for i in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i,) for i in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 1) for i in parts], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    left = {i: None if i % 7 == 0 else i % 100 for i in customers}
    right = {i: None if i % 500 == 0 else i % 1000 for i in orders}
    pairs = {(i, j) for i, a in left.items() for j, b in right.items() if a == b}
    lone = {(i, None) for i in left if not any(i == p[0] for p in pairs)}
    other = {(None, j) for j in right if not any(j == p[1] for p in pairs)}
    assert len(pairs) > 20 * len({p for p in pairs if p[1] % 20 == 0 and p[0] % 7})
    found = {name: [tuple(r) for r in f(spark, str(tmp_path)).collect()] for name, f in catalogue.queries().items() if name.rsplit("_", 1)[0] in ("sort_merge_join", "hash_join") or name in JOINS}
    assert len(found) == 15
    for how, more in (("none", set()), ("left", lone), ("right", other), ("both", lone | other)):
        for join in ("sort_merge_join", "hash_join"):
            assert sorted(((r[0], r[2]) for r in found[f"{join}_{how}"]), key=str) == sorted(pairs | more, key=str)
    for join in ("sort_merge", "hash", "nested_loop"):
        met = {p[0] for p in pairs if join != "nested_loop" or left[p[0]] is not None}
        assert sorted(r[0] for r in found[f"{join}_semi_join"]) == sorted(met)
        assert sorted(r[0] for r in found[f"{join}_anti_join"]) == sorted(set(left) - met)
    assert sorted(found["band_join"]) == [(a, b) for a in parts for b in parts if abs(a - b) <= 3]


def test_theta_joins_without_broadcasting(spark):
    """Too large for a broadcast: block by block, and neither a broadcast nor a cartesian product in the plan."""
    from pyspark.sql import functions as F

    from relplan.operators import joins as J

    a, b = spark.range(40).select(F.col("id").alias("x")).unionAll(spark.range(3).select(F.lit(None).cast("long").alias("x"))), spark.range(5, 30, 3).select(F.col("id").alias("y"))
    on = "a.x < b.y AND a.x + b.y > 20"
    want = [(x, y) for x in range(40) for y in range(5, 30, 3) if x < y and x + y > 20]
    met = {x for x, _ in want}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inner, left = (J.nested_loop_join(a, b, on, how, ("a", "b")) for how in ("none", "left"))
        semi, anti = (J.nested_loop_semi_join(a, b, on, how, ("a", "b")) for how in ("semi", "anti"))
        for df in (inner, left, semi, anti):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        rows = lambda df: sorted(((r.left.x, r.right.y if r.right else None) for r in df.collect()), key=str)
        rest = [x for x in [*range(40), None, None, None] if x not in met]
        assert rows(inner) == sorted(want, key=str) and rows(left) == sorted([*want, *((x, None) for x in rest)], key=str)
        assert sorted(r.x for r in semi.collect()) == sorted(met) and sorted((r.x for r in anti.collect()), key=str) == sorted(rest, key=str)
        assert J.nested_loop_join(a, b, None).count() == 43 * 9 and J.nested_loop_semi_join(a, b, None, "anti").count() == 0
        assert J.nested_loop_join(a, b.where("false"), None, "left").count() == 43
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_offset_keeps_the_order_and_the_partitions(spark):
    from relplan.operators import relational as R

    df = R.sort(spark.range(0, 1000, 1, 7), ["id"], [False])
    for offset in (1, 250, 999, 1000, 5000):
        assert [r.id for r in R.offset_limit(df, offset).collect()] == list(range(999, -1, -1))[offset:]


def test_checkpoints_of_the_log(spark):
    from relplan.sources import shared
    from relplan.sources.tables import Database

    db = Database(spark, shared.new_path(spark, "db"))
    db.create_table("t", id="BIGINT")
    for i in range(70):
        tx = db.begin()
        tx.abort() if i == 20 else tx.commit()
    assert db.files.names("checkpoints") and db.begin().snapshot.unseen == (21,)
    assert [db.status(i) for i in (1, 21, 70, 71, 99)] == ["committed", "aborted", "committed", "in_progress", "unassigned"] and db.horizon() == 71
