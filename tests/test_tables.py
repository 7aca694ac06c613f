import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relplan.operators.relational import selection
from relplan.sources.tables import Conflict, Database, Snapshot, can_vacuum


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.create_table("t", id="BIGINT", name="TEXT")
    return db


def put(db, *rows, table="t"):
    tx = db.begin()
    tx.insert(table, db.spark.createDataFrame(list(rows), "id long, name string"))
    tx.commit()


def ids(tx, table="t"):
    return sorted(r.id for r in tx.scan(table).collect())


def test_empty_table(db):
    assert db.begin().scan("t").collect() == [] and db.begin().scan("t", pointers=True).columns[:3] == ["table_id", "partition_id", "tuple_pointer"]


def test_isolation(db):
    put(db, (1, "a"), (2, "b"))
    old, writer = db.begin(), db.begin()
    writer.insert("t", db.spark.createDataFrame([(3, "c")], "id long, name string"))
    writer.delete("t", selection(writer.scan("t", pointers=True), "id = 1"))
    assert ids(writer) == [2, 3] and ids(old) == [1, 2]
    writer.commit()
    assert ids(old) == [1, 2] and ids(db.begin()) == [2, 3]
    assert db.status(writer.snapshot.own) == "committed" and db.status(old.snapshot.own) == "in_progress" and db.status(99) == "unassigned"


def test_abort(db):
    put(db, (1, "a"))
    tx = db.begin()
    tx.delete("t", tx.scan("t", pointers=True))
    tx.abort()
    assert ids(db.begin()) == [1] and db.status(tx.snapshot.own) == "aborted"
    with pytest.raises(RuntimeError):
        tx.commit()


def test_two_deletes_of_one_row_conflict(db):
    put(db, (1, "a"), (2, "b"))
    one, two, three = db.begin(), db.begin(), db.begin()
    one.delete("t", selection(one.scan("t", pointers=True), "id = 1"))
    two.delete("t", selection(two.scan("t", pointers=True), "id = 1"))
    three.delete("t", selection(three.scan("t", pointers=True), "id = 2"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    three.commit()
    assert ids(db.begin()) == []


def test_schema_changes(db):
    put(db, (1, "a"))
    db.add_column("t", "extra", "INT[2]")
    tx = db.begin()
    tx.insert("t", db.spark.createDataFrame([(2, "b", 5)], "id long, name string, extra int"))
    tx.commit()
    db.drop_column("t", "name")
    db.rename_column("t", "extra", "more")
    db.add_column("t", "name", "TEXT")  # a new column, not the old one
    assert sorted(map(tuple, db.begin().scan("t").collect())) == [(1, None, None), (2, 5, None)]
    assert db.partitions("t") == [1, 2, 3, 4]
    db.rename_table("t", "u")
    assert db.tables() == ["u"] and ids(db.begin(), "u") == [1, 2]
    db.drop_table("u")
    assert db.tables() == []


def test_catalogue_refusals(db):
    for bad in (lambda: db.create_table("t", x="INT"), lambda: db.create_table("e"), lambda: db.add_column("t", "id", "INT"), lambda: db.rename_column("t", "id", "name")):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: db.drop_column("t", "zz"), lambda: db.schema("zz"), lambda: db.drop_index("t", "zz")):
        with pytest.raises(KeyError):
            bad()


def test_indices(db):
    db.create_index("t", "by_id", "id % 10", "hash", "id > 5")
    db.rename_index("t", "by_id", "mod")
    assert [i["name"] for i in db.indices("t")] == ["mod"]
    db.drop_index("t", "mod")
    assert db.indices("t") == []


def test_insert_checks_types(db):
    tx = db.begin()
    with pytest.raises(TypeError):
        tx.insert("t", db.spark.createDataFrame([("x", "y")], "id string, name string"))
    with pytest.raises(PySparkException):
        tx.insert("t", db.spark.createDataFrame([(1.5,)], "id double"))
    tx.insert("t", db.spark.createDataFrame([(4.0,)], "key double"), {"id": "key"})
    assert [tuple(r) for r in tx.scan("t").collect()] == [(4, None)]


def test_returning_and_lookup(db):
    put(db, (1, "a"), (2, "b"), (3, "c"))
    tx = db.begin()
    statement = tx.insert("t", db.spark.createDataFrame([(9, "z")], "id long, name string"))
    assert [r.id for r in tx.scan("t", pointers=True, statement=statement).collect()] == [9]
    pointers = selection(tx.scan("t", pointers=True), "id <> 2").select("partition_id", "tuple_pointer")
    kept = db.spark.createDataFrame(pointers.collect() * 2, pointers.schema)
    assert sorted(r.id for r in tx.lookup("t", kept).collect()) == [1, 1, 3, 3, 9, 9]
    tx.delete("t", selection(tx.scan("t", pointers=True), "id = 1"))
    assert sorted(r.id for r in tx.lookup("t", kept).collect()) == [3, 3, 9, 9]
    with pytest.raises(ValueError):
        tx.lookup("t", kept.withColumn("partition_id", F.lit(77)))


def test_update(db):
    put(db, (1, "a"), (2, "b"))
    tx = db.begin()
    tx.update("t", "id = 2", name="name || '!'", id="id + 10")
    tx.commit()
    assert sorted(map(tuple, db.begin().scan("t").collect())) == [(1, "a"), (12, "b!")]


def test_a_scan_does_not_see_its_own_statement(db):
    put(db, (1, "a"), (2, "b"))
    tx = db.begin()
    tx.insert("t", tx.scan("t").selectExpr("id + 100 AS id", "name"))
    assert ids(tx) == [1, 2, 101, 102]


def test_visibility_rules(spark):
    s = Snapshot(own=10, least=9, unseen=(3, 5), commits=0)
    df = spark.createDataFrame([(1, None), (3, None), (1, 2), (1, 5), (10, None), (10, 10), (11, None), (1, 12)], "xmin long, xmax long")
    assert [r[0] for r in df.select(s.visible(F.col("xmin"), F.col("xmax"))).collect()] == [True, False, False, True, True, False, False, True]
    assert [r[0] for r in df.select(s.can_delete(F.col("xmin"), F.col("xmax"), (12,))).collect()] == ["can_delete", "invisible", "invisible", "must_abort", "can_delete", "invisible", "invisible", "wait"]
    assert [r[0] for r in df.select(can_vacuum(F.col("xmax"), 9, F.col("xmax") != 5)).collect()][2:4] == [True, False]


def test_horizon(db):
    a = db.begin()
    put(db, (1, "a"))
    assert db.horizon() == a.snapshot.own
    a.abort()
    assert db.horizon() == 3
