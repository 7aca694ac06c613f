"""Joins.  Those on keys treat null as equal to null; those on expressions follow SQL.

Rows come out as {left, right}; the missing side of an outer join is a null tuple.
The algorithm is a hint: merge and hash join give the same rows.

A join on any expression is left to Spark, which broadcasts the right side, where
that lies below the session's size threshold.  Otherwise both sides are dealt
into blocks, and every pair of blocks is one group of an equality join, which
spills: memory is bounded by blocks, whatever the sizes.

A join on keys that repeat on both sides gives far more rows than it reads. The
rows of a key with many pairs are dealt into blocks, and the blocks into so many
partitions that each writes about as many rows, whatever the sizes of the inputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relplan.functions import expressions as E
from relplan.functions import paths
from relplan.functions.types import comparable
from relplan.sources import shared

PRESERVE = {"none": "inner", "left": "left", "right": "right", "both": "full"}
SEMI = {"semi": "left_semi", "anti": "left_anti"}
#: Pairs of a block of one key, left rows of a block where the key has more pairs than that, rows of a block on either side, and pairs of a partition.
PAIRS, LEFT_ROWS, ROWS, PARTITION_PAIRS = 1 << 22, 1 << 12, 1 << 17, 1 << 24


def wrapped(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(paths.quoted(c)) for c in df.columns]).alias(name))


def flat(joined: DataFrame) -> DataFrame:
    """{left, right} with the columns of both, prefixed left_ and right_."""
    return joined.select(*[F.col(side)[f.name].alias(f"{side}_{f.name}") for side in ("left", "right") for f in joined.schema[side].dataType.fields])


def _equal(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], left_root: Column | None, right_root: Column | None) -> Column:
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("both sides need the same number of keys, at least one")
    out = []
    for a, b in zip(left_keys, right_keys, strict=True):
        (x, kx), (y, ky) = paths.find(left.schema, a, left_root), paths.find(right.schema, b, right_root)
        if not comparable(kx, ky):
            raise TypeError(f"keys {a} and {b} can't be compared")
        out.append(x.eqNullSafe(y))
    return reduce(lambda a, b: a & b, out)


def _keyed(left, left_keys, right, right_keys, preserve, hint):
    if preserve not in PRESERVE:
        raise ValueError(f"preserve must be one of {sorted(PRESERVE)}")
    on = _equal(left, left_keys, right, right_keys, F.col("left"), F.col("right"))
    one, other = wrapped(left, "left"), wrapped(right, "right")
    if hint and not left.isStreaming and not right.isStreaming and (kinds := _kinds(left, left_keys, right, right_keys)):
        keys = [F.struct(*[_exact(paths.find(df.schema, k, F.col(side))[0].cast(t), t).alias(f"_{i}") for i, (k, t) in enumerate(zip(own, kinds, strict=True))]) for side, df, own in (("left", left, left_keys), ("right", right, right_keys))]
        if (joined := _dealt(one, keys[0], other, keys[1], PRESERVE[preserve], hint)) is not None:
            return joined
    return one.join(other.hint(hint) if hint else other, on, PRESERVE[preserve])


def _kinds(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path]) -> list[T.DataType] | None:
    """The types in which keys of both sides meet; None where they only meet in a comparison."""
    out = []
    for a, b in zip(left_keys, right_keys, strict=True):
        x, y = paths.find(left.schema, a)[1], paths.find(right.schema, b)[1]
        if x != y and not (isinstance(x, _PLAIN) and isinstance(y, _PLAIN)) or "void" in x.simpleString():
            return None
        out.append(x if x == y else max(x, y, key=lambda t: _PLAIN.index(type(t))) if {type(x), type(y)} <= set(_PLAIN[:4]) else T.DoubleType())
    return out


_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _exact(value: Column, kind: T.DataType) -> Column:
    """The same for equal values only; of floating numbers their text, since Spark would deal rows by those once more."""
    return (value.cast("double") + F.lit(0.0)).cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def _numbered(df: DataFrame) -> DataFrame:
    """With _id, the same in every run of a task; a hash of the row where it can't be written."""
    if "void" in df.schema.simpleString():
        return df.withColumn("_id", F.xxhash64(df.columns[0]))
    return shared.keep(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")


def _dealt(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, how: str, hint: str) -> DataFrame | None:
    """The join in blocks of each key's pairs; None where the pairs are few beside the rows.

    Every left row meets each block of its key's right rows and the reverse, so a
    row that has a partner finds it in some block; where it finds none in a block
    of its own key, an outer join's row of it is left out.
    """
    a, b = (df.groupBy(key.alias("_key")).count().withColumnRenamed("count", name) for df, key, name in ((left, left_key, "_l"), (right, right_key, "_r")))
    per = a.join(b, "_key", "full").select("_key", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("_l", "_r")])
    pairs = F.col("_l") * F.col("_r")
    wide = (pairs > PAIRS) | (F.col("_l") > ROWS) | (F.col("_r") > ROWS)
    rows, total, some = per.agg(F.sum(F.col("_l") + F.col("_r")), F.sum(pairs), F.max(wide)).first()
    if not some and (total or 0) <= max(PAIRS, 4 * (rows or 0)):
        return None
    n = F.greatest(F.lit(1), F.ceil(F.col("_l") / ROWS), F.least(F.ceil(F.col("_l") / LEFT_ROWS), F.ceil(pairs / PAIRS)))
    m = F.greatest(F.lit(1), F.ceil(F.col("_r") / ROWS), F.ceil(F.col("_r") * F.ceil(F.col("_l") / F.col("_n")) / PAIRS))
    hot = shared.keep(per.where(wide).withColumn("_n", n.cast("int")).withColumn("_m", m.cast("int")).select("_key", "_n", "_m", (pairs > 0).alias("_met")), "keys")
    partitions = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 15, math.ceil(total / PARTITION_PAIRS)))

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        at = df.join(hot, "_key", "left").withColumn(own, F.pmod(F.xxhash64("_id"), F.coalesce(f"{own}_of", F.lit(1))).cast("int"))
        return at.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_of", F.lit(1)) - 1)))

    hot = hot.withColumnsRenamed({"_n": "_i_of", "_m": "_j_of"})
    block = T.StructType([T.StructField("_key", hot.schema["_key"].dataType), T.StructField("_i", T.IntegerType()), T.StructField("_j", T.IntegerType())])  # of one type on both sides, or Spark deals the rows once more
    left, right = _numbered(left).withColumn("_key", left_key), _numbered(right).withColumn("_key", right_key)
    one, two = (
        blocks(df, own, other).select(side, F.struct("_key", "_i", "_j").cast(block).alias(f"_{side}_block"), F.coalesce("_met", F.lit(False)).alias(f"_{side}_met")).repartition(partitions, f"_{side}_block")
        for side, df, own, other in (("left", left, "_i", "_j"), ("right", right, "_j", "_i"))
    )
    joined = one.join(two.hint(hint), F.col("_left_block") == F.col("_right_block"), "left" if how == "full" else how)
    if how in ("left", "full"):
        joined = joined.where(F.col("_right_block").isNotNull() | ~F.col("_left_met"))
    if how == "right":
        joined = joined.where(F.col("_left_block").isNotNull() | ~F.col("_right_met"))
    joined = joined.select("left", "right")
    if how == "full":  # Spark's full joins hold the rows of a key on both sides
        joined = joined.unionByName(right.join(a.select("_key"), "_key", "left_anti").select(F.lit(None).cast(joined.schema["left"].dataType).alias("left"), "right"))
    return joined


def sort_merge_join(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], preserve: str = "none") -> DataFrame:
    """Equality join by sorting both sides; they may come in any order."""
    return _keyed(left, left_keys, right, right_keys, preserve, "merge")


def hash_join(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], preserve: str = "none") -> DataFrame:
    """Equality join by hash tables of the right side's partitions."""
    return _keyed(left, left_keys, right, right_keys, preserve, "shuffle_hash")


def equi_join(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], preserve: str = "none") -> DataFrame:
    """Equality join by whatever Catalyst finds best; a side is broadcast only below the session's size threshold."""
    return _keyed(left, left_keys, right, right_keys, preserve, None)


def _theta(left: DataFrame, right: DataFrame, expression: str | None, names: tuple[str, str], roots: tuple[Column | None, Column | None]) -> Column | None:
    if expression is None:
        return None
    return E.condition(expression, E.Scope([(names[0], left.schema, roots[0]), (names[1], right.schema, roots[1])]))


def _bytes(df: DataFrame) -> int:
    """Spark's estimate of the size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame) -> bool:
    """Whether the side may be broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= _bytes(df) <= limit


def _blocks(left: DataFrame, right: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_i, _j), the pair of blocks; each row once for every block of the other side."""
    n, m = (max(1, min(1 << 12, math.ceil(_bytes(x) / block_bytes))) for x in (left, right))

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        column = df.columns[0]
        return df.withColumn(own, F.pmod(F.xxhash64(column), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    return dealt(left, "_i", n, "_j", m), dealt(right, "_j", m, "_i", n)


def _in_blocks(left: DataFrame, right: DataFrame, on: Column | None, how: str, block_bytes: int = 32 << 20) -> DataFrame:
    """Theta join of {left} and {right} block by block: inner, left, left_semi or left_anti."""
    if how == "inner":
        a, b = _blocks(left, right, block_bytes)
        return a.join(b.hint("merge"), (a["_i"] == b["_i"]) & (a["_j"] == b["_j"]) & (F.lit(True) if on is None else on)).select("left", "right")
    numbered = shared.keep(left.withColumn("_id", F.monotonically_increasing_id()), "left")
    a, b = _blocks(numbered, right, block_bytes)
    same = (a["_i"] == b["_i"]) & (a["_j"] == b["_j"]) & (F.lit(True) if on is None else on)
    if how == "left":
        pairs = shared.keep(a.join(b.hint("merge"), same).select("_id", "left", "right"), "pairs")
        lone = numbered.join(pairs.select("_id").distinct(), "_id", "left_anti").select("left", F.lit(None).cast(right.schema["right"].dataType).alias("right"))
        return pairs.select("left", "right").unionByName(lone)
    met = a.join(b.hint("merge"), same, "left_semi").select("_id").distinct()
    return numbered.join(met, "_id", how).select("left")


def nested_loop_join(left: DataFrame, right: DataFrame, expression: str | None, preserve: str = "none", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Join on any expression over both inputs, all pairs without one; inner, or preserving the left."""
    if preserve not in ("none", "left"):
        raise ValueError("this join preserves the left side or none")
    on = _theta(left, right, expression, names, (F.col("left"), F.col("right")))
    a, b = wrapped(left, "left"), wrapped(right, "right")
    if not fits(b):
        return _in_blocks(a, b, on, PRESERVE[preserve])
    if on is None:
        return a.crossJoin(b) if preserve == "none" else a.join(b, F.lit(True), "left")
    return a.join(b, on, PRESERVE[preserve])


def band_join(left: DataFrame, left_key: paths.Path, right: DataFrame, right_key: paths.Path, width: int, preserve: str = "none") -> DataFrame:
    """Rows whose integer keys differ by at most ``width``, as an equality join on bands of keys instead of all pairs."""
    if width < 0 or preserve not in ("none", "left"):
        raise ValueError("width must not be negative; the left side or none is preserved")
    x, y = paths.find(left.schema, left_key, F.col("left"))[0].cast("decimal(38,0)"), paths.find(right.schema, right_key, F.col("right"))[0].cast("decimal(38,0)")
    size = F.lit(max(1, width)).cast("decimal(20,0)")
    a = wrapped(left, "left").withColumn("_band", F.floor(x / size))
    b = wrapped(right, "right").withColumn("_near", F.explode(F.array(*[F.floor(y / size) + d for d in (-1, 0, 1)])))
    return a.join(b, (F.col("_band") == F.col("_near")) & (F.abs(x - y) <= width), PRESERVE[preserve]).select("left", "right")


def _sided(left: DataFrame, right: DataFrame, on: Column, kind: str, hint: str | None) -> DataFrame:
    if kind not in SEMI:
        raise ValueError("kind must be semi or anti")
    names = left.columns
    joined = wrapped(left, "left").join(wrapped(right, "right").hint(hint) if hint else wrapped(right, "right"), on, SEMI[kind])
    return joined.select(*[F.col("left")[n].alias(n) for n in names])


def _key_semi(left, left_keys, right, right_keys, kind, hint):
    return _sided(left, right, _equal(left, left_keys, right, right_keys, F.col("left"), F.col("right")), kind, hint)


def sort_merge_semi_join(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], kind: str = "semi") -> DataFrame:
    """Left rows with (semi) or without (anti) an equal key on the right, as they are."""
    return _key_semi(left, left_keys, right, right_keys, kind, "merge")


def hash_semi_join(left: DataFrame, left_keys: Sequence[paths.Path], right: DataFrame, right_keys: Sequence[paths.Path], kind: str = "semi") -> DataFrame:
    """As :func:`sort_merge_semi_join`, by hash tables of the right keys."""
    return _key_semi(left, left_keys, right, right_keys, kind, "shuffle_hash")


def _two_sided(left: DataFrame, right: DataFrame, expression: str, names: tuple[str, str]) -> list[tuple[str, Column, Column]] | None:
    """An expression as comparisons [(operator, of the right, of the left)] by < <= > >= of values that have an order; else None."""
    one, other = E.Scope([(names[0], left.schema, None)]), E.Scope([(names[1], right.schema, None)])
    turned, out = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}, []
    for op, a, b in E.comparisons(expression) or []:
        if (y := E.within(a, other)) and (x := E.within(b, one)):
            pass
        elif (x := E.within(a, one)) and (y := E.within(b, other)):
            op = turned.get(op, op)
        else:
            return None
        if op not in turned or not (x.kind == y.kind and isinstance(x.kind, (*_PLAIN, T.StringType, T.DecimalType)) or isinstance(x.kind, _PLAIN) and isinstance(y.kind, _PLAIN)):
            return None
        if isinstance(x.kind, _PLAIN[4:]) or isinstance(y.kind, _PLAIN[4:]):  # zeros of both signs are equal
            x, y = (E.Value(v.column.cast("double") + F.lit(0.0), T.DoubleType()) for v in (x, y))
        out.append((op, y.column, x.column))
    return out or None


def _steps(left: DataFrame, right: DataFrame, expression: str, kind: str, names: tuple[str, str]) -> DataFrame | None:
    """Semi or anti join by one or two comparisons, each of a right value with a left one, without pairs; None for other expressions.

    Of the right rows only the best second value for each first one counts. They
    are put in one order with the left rows, dealt into ranges of it, and a left row
    is met if the best second value so far passes its own: no task sees all rows.
    """
    if (tests := _two_sided(left, right, expression, names)) is None or len(tests) > 2 or left.isStreaming or right.isStreaming or "void" in left.schema.simpleString():
        return None
    (op, b, x), (last, d, y) = tests[0], (tests[1] if len(tests) > 1 else ("<=", F.lit(0), F.lit(0)))
    best = F.max if last[0] == ">" else F.min
    passes = {"<": F.col("_so_far") < F.col("_own"), "<=": F.col("_so_far") <= F.col("_own"), ">": F.col("_so_far") > F.col("_own"), ">=": F.col("_so_far") >= F.col("_own")}[last]
    first = 1 if op in ("<", ">") else 0  # right rows of an equal value come after the left ones, or before
    row = F.struct(*[F.col(paths.quoted(c)) for c in left.columns])
    rights = right.select(b.alias("_at"), d.alias("_best")).where("_at IS NOT NULL AND _best IS NOT NULL").groupBy("_at").agg(best("_best").alias("_best"))
    lefts = left.select(row.alias("left"), x.alias("_at"), y.alias("_own"), F.lit(1 - first).alias("_turn"), F.xxhash64(*[F.col(paths.quoted(c)) for c in left.columns]).alias("_tie"))
    rows = lefts.unionByName(rights.select("_at", "_best", F.lit(first).alias("_turn"), F.lit(0).cast("long").alias("_tie")), allowMissingColumns=True)
    order = [F.col("_at").asc_nulls_first() if op[0] == "<" else F.col("_at").desc_nulls_last(), F.col("_turn"), F.col("_tie")]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = shared.keep(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = table.groupBy("_range").agg(best("_best").alias("_end"))
    before = ends.select("_range", best("_end").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    so_far = best("_best").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = table.withColumn("_inside", so_far).join(F.broadcast(before), "_range")  # one row for each of n ranges
    whole = whole.withColumn("_so_far", (F.greatest if best is F.max else F.least)("_inside", "_before"))
    met = F.coalesce(passes & F.col("_at").isNotNull(), F.lit(False))
    return whole.where((F.col("_turn") == 1 - first) & (met if kind == "semi" else ~met)).select(*[F.col("left")[c].alias(c) for c in left.columns])


def nested_loop_semi_join(left: DataFrame, right: DataFrame, expression: str | None, kind: str = "semi", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Left rows with or without a right row for which the expression is true; without one, any right row counts."""
    on = _theta(left, right, expression, names, (F.col("left"), F.col("right")))
    if kind in SEMI and expression is not None and (met := _steps(left, right, expression, kind, names)) is not None:
        return met
    if kind in SEMI and not fits(right):
        return _in_blocks(wrapped(left, "left"), wrapped(right, "right"), on, SEMI[kind]).select(*[F.col("left")[n].alias(n) for n in left.columns])
    return _sided(left, right, F.lit(True) if on is None else on, kind, None)
