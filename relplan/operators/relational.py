"""Filters, projections, row transformers, sorting, limits and unions: functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relplan.functions import expressions as E
from relplan.functions import paths
from relplan.functions.types import comparable
from relplan.sources import shared


def scope(df: DataFrame, table: str = "", tolerant: bool = False) -> E.Scope:
    return E.Scope([(table, df.schema, None)], tolerant)


def identity(df: DataFrame) -> DataFrame:
    """What carries transformers: the input as it is."""
    return df


def transformed(df: DataFrame, *transformers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transformers applied one after the other; Catalyst fuses them with what stands below."""
    return reduce(lambda d, t: t(d), transformers, df)


def selection(df: DataFrame, expression: str | Column, table: str = "") -> DataFrame:
    """Rows for which the expression is true; an error in it fails the query."""
    return df.filter(E.condition(expression, scope(df, table)) if isinstance(expression, str) else expression)


def selection_dropping_errors(expression: str, table: str = "") -> Callable[[DataFrame], DataFrame]:
    """A transformer that keeps rows for which the expression is true and drops those where it can't be evaluated."""

    def apply(df: DataFrame) -> DataFrame:
        s = scope(df, table, tolerant=True)
        keep = E.condition(expression, s)
        failed = reduce(lambda a, b: a | b, (F.coalesce(f, F.lit(False)) for f in s.failures), F.lit(False))
        return df.filter(keep & ~failed)

    return apply


def projection(df: DataFrame, outputs: Sequence[paths.Path | Column], table: str = "") -> DataFrame:
    """Columns proj_0, proj_1 ...: a path (an int, a tuple or SELF) is taken as it is, text is an expression."""
    s, out = scope(df, table), []
    for i, o in enumerate(outputs):
        if isinstance(o, Column):
            column = o
        elif isinstance(o, str) and o != paths.SELF:
            column = E.read(o, s).column
        else:
            column = paths.find(df.schema, o)[0]
        out.append(column.alias(f"proj_{i}"))
    return df.select(*out)


def simple_projection(table: str, positions: Sequence[paths.Path], names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A transformer that picks paths under new names and calls the result ``table``."""
    return lambda df: df.select(*[paths.find(df.schema, p)[0].alias(n) for p, n in zip(positions, names, strict=True)]).alias(table)


def sort_columns(df: DataFrame, keys: Sequence[paths.Path], ascending: Sequence[bool] | None = None) -> list[Column]:
    """Null is least: first when ascending, last when descending."""
    up = ascending or [True] * len(keys)
    columns = [paths.find(df.schema, k)[0] for k in keys]
    return [c.asc_nulls_first() if a else c.desc_nulls_last() for c, a in zip(columns, up, strict=True)]


def row_number(keys: Sequence[paths.Path], ascending: Sequence[bool] | None = None, start: int = 0, partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A transformer to {row_number, row}, numbered without gaps in the order of ``keys``; equal rows in any order.

    Rows are dealt into ranges of the keys, written with their range, and numbered
    inside each range on top of the counts of those before: no task sees all rows.
    """

    def apply(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        order = sort_columns(df, keys, ascending)
        tie = F.xxhash64(*[F.col(paths.quoted(c)) for c in df.columns])
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        row = F.struct(*[F.col(paths.quoted(c)) for c in df.columns]).alias("row")
        dealt = df.withColumn("_tie", tie).repartitionByRange(n, *order, F.col("_tie")).withColumn("_range", F.spark_partition_id())
        table = shared.keep(dealt.select("_range", "_tie", row), "ranges")
        counts = table.groupBy("_range").count()
        before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
        inner = [paths.find(df.schema, k, F.col("row"))[0] for k in keys]
        up = ascending or [True] * len(keys)
        within = Window.partitionBy("_range").orderBy(*[c.asc_nulls_first() if a else c.desc_nulls_last() for c, a in zip(inner, up, strict=True)], "_tie")
        numbered = table.withColumn("_n", F.row_number().over(within)).join(F.broadcast(before), "_range")  # one row for each of n ranges
        return numbered.select((F.col("_before") + F.col("_n") + F.lit(start - 1)).alias("row_number"), "row")

    return apply


def row_identifier(value) -> Callable[[DataFrame], DataFrame]:
    """A transformer to {row_identifier, row} with one constant."""
    return lambda df: df.select(F.lit(value).alias("row_identifier"), F.struct(*[F.col(paths.quoted(c)) for c in df.columns]).alias("row"))


def mapped(function: Callable, schema: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A transformer of the user's: DataFrame to DataFrame, or with a schema, batches of pandas to batches of pandas."""
    return function if schema is None else lambda df: df.mapInPandas(function, schema)


def sort(df: DataFrame, keys: Sequence[paths.Path], ascending: Sequence[bool] | None = None, first: int | None = None) -> DataFrame:
    """All rows in order, or only the ``first`` so many."""
    if first is not None and first <= 0:
        raise ValueError("a sort must return at least one row")
    out = df.orderBy(*sort_columns(df, keys, ascending))
    return out if first is None else out.limit(first)


def offset_limit(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """At most ``limit`` rows after the first ``offset``."""
    if offset < 0 or limit is not None and limit <= 0:
        raise ValueError("offset must be finite and limit positive")
    if not offset or limit is not None:
        return df.offset(offset).limit(limit) if offset else df if limit is None else df.limit(limit)
    # without a limit no task may see all rows: the partition in which the offset ends is found from their counts
    table = shared.keep(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    first, left = 0, offset
    for part, n in sorted(table.groupBy(F.shiftright("_place", 33)).count().collect()):  # one row for each partition
        first = (part << 33) + left
        if left < n:
            break
        left -= n
        first = (part + 1) << 33
    return table.where(F.col("_place") >= first).orderBy("_place").drop("_place")


def same_layout(frames: Sequence[DataFrame]) -> None:
    for df in frames[1:]:
        kinds = [f.dataType for f in df.schema], [f.dataType for f in frames[0].schema]
        if len(kinds[0]) != len(kinds[1]) or any(a != b for a, b in zip(*kinds, strict=True)):
            raise TypeError("all inputs must have the same columns")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs, with repetitions, under the names of the first; types must agree."""
    if not frames:
        raise ValueError("a union needs an input")
    same_layout(frames)
    return reduce(DataFrame.union, frames)


def merge_sorted(frames: Sequence[DataFrame], keys: Sequence[paths.Path], ascending: Sequence[bool] | None = None) -> DataFrame:
    """Sorted inputs as one sorted output."""
    return sort(union(frames), keys, ascending)


def match(left: DataFrame, right: DataFrame, keys: Sequence[paths.Path] | None = None) -> DataFrame:
    """One row {matched, left_rows, right_rows, first_mismatch}.

    With ``keys`` both sides are put in that order and compared row by row (nulls
    are equal); without, they are compared as bags and first_mismatch is null.
    """
    if len(left.columns) != len(right.columns) or not all(comparable(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema, strict=True)):
        raise TypeError("the inputs can't be compared")
    right = right.toDF(*left.columns)
    if keys is None:
        both = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(right.withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
        per = both.groupBy(*[paths.quoted(c) for c in left.columns]).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
        return per.agg(F.coalesce(F.max(F.when(F.col("l") != F.col("r"), 1)), F.lit(0)).alias("bad"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows")).select((F.col("bad") == 0).alias("matched"), "left_rows", "right_rows", F.lit(None).cast("long").alias("first_mismatch"))
    one, two = row_number(keys)(left).toDF("i", "l"), row_number(keys)(right).toDF("i", "r")
    paired = one.join(two, "i", "full")
    return paired.agg(F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("i"))).alias("bad"), F.count("l").alias("left_rows"), F.count("r").alias("right_rows")).select(F.col("bad").isNull().alias("matched"), "left_rows", "right_rows", F.col("bad").cast("long").alias("first_mismatch"))
