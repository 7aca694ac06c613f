"""Aggregation without groups, by keys, and by runs of sorted rows.

Functions: count, min, max and sum, over a path or the whole row; more can be given
as functions from a column to a column, or as pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relplan.functions import paths
from relplan.functions.expressions import Value, lossless_sum
from relplan.functions.types import family

from relplan.sources import shared

from .relational import row_number, sort_columns

Call = tuple[str | Callable[..., Column], paths.Path | Sequence[paths.Path]]


def _orderable(kind) -> bool:
    if family(kind) == "tuple":
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if family(kind) == "array" else family(kind) != "json"


def call(df: DataFrame, function: str | Callable[..., Column], path) -> Column:
    """One aggregate over the rows of ``df``; a list of paths gives a function several inputs."""
    if not isinstance(function, str):
        many = path if isinstance(path, list) else [path]
        return function(*[paths.find(df.schema, p)[0] for p in many])
    column, kind = paths.find(df.schema, path)
    if function == "count":
        return F.count(F.lit(1)) if path == paths.SELF else F.count(column)
    if function in ("min", "max"):
        if not _orderable(kind):
            raise TypeError(f"{kind.simpleString()} has no order")
        return F.min(column) if function == "min" else F.max(column)
    if function == "sum":
        return lossless_sum(Value(column, kind))
    raise ValueError(f"no aggregate {function}")


def pandas_aggregate(function: Callable, result: str) -> Callable[..., Column]:
    """An aggregate of the user's: pandas series of a whole group to one value."""
    return F.pandas_udf(function, result, F.PandasUDFType.GROUPED_AGG)


def _calls(df: DataFrame, calls: Sequence[Call]) -> list[Column]:
    return [call(df, f, p).alias(f"agg_{i}") for i, (f, p) in enumerate(calls)]


def simple_aggregation(df: DataFrame, calls: Sequence[Call]) -> DataFrame:
    """Exactly one row agg_0, agg_1 ..., also over no rows."""
    if not calls:
        raise ValueError("at least one aggregate is needed")
    return df.agg(*_calls(df, calls))


def hash_aggregation(df: DataFrame, keys: Sequence[paths.Path], calls: Sequence[Call] = ()) -> DataFrame:
    """One row key_0 ... agg_0 ... for each group; null keys form one.  Without aggregates, the distinct keys."""
    columns = [paths.find(df.schema, k)[0].alias(f"key_{i}") for i, k in enumerate(keys)]
    if not columns:
        raise ValueError("at least one key is needed")
    return df.groupBy(*columns).agg(*_calls(df, calls)) if calls else df.select(*columns).distinct()


def sorted_aggregation(df: DataFrame, keys: Sequence[paths.Path], calls: Sequence[Call] = (), order: Sequence[paths.Path] | None = None, within: Sequence[paths.Path] = ()) -> DataFrame:
    """Groups of input sorted by ``keys``; with another ``order``, one row for each run of equal keys in that order.

    Runs are found inside each group of ``within``, or over all rows, which are
    then numbered by ranges, so that no task sees all of them.
    """
    if order is None:
        return hash_aggregation(df, keys, calls)
    if not within:
        numbered = _numbered_runs(df, keys, order)
        columns = [paths.find(df.schema, k)[0].alias(f"key_{i}") for i, k in enumerate(keys)]
        return numbered.groupBy(*columns, "_run").agg(*(_calls(df, calls) or [F.count(F.lit(1)).alias("_n")])).drop("_run", "_n")
    key = F.struct(*[paths.find(df.schema, k)[0].alias(f"k{i}") for i, k in enumerate(keys)])
    part = [paths.find(df.schema, w)[0] for w in within]
    by = Window.partitionBy(*part).orderBy(*sort_columns(df, order))
    marked = df.withColumn("_new", F.coalesce((~key.eqNullSafe(F.lag(key).over(by))).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    columns = [paths.find(df.schema, k)[0].alias(f"key_{i}") for i, k in enumerate(keys)]
    hidden = [paths.find(df.schema, w)[0].alias(f"_w{i}") for i, w in enumerate(within)]
    return runs.groupBy(*columns, *hidden, "_run").agg(*(_calls(df, calls) or [F.count(F.lit(1)).alias("_n")])).drop("_run", "_n", *[f"_w{i}" for i in range(len(within))])


def _numbered_runs(df: DataFrame, keys: Sequence[paths.Path], order: Sequence[paths.Path]) -> DataFrame:
    """``df`` with _run, the number of its run of equal keys in that order."""
    numbered = row_number(order)(df)
    key = F.struct(*[paths.find(df.schema, k, F.col("row"))[0].alias(f"k{i}") for i, k in enumerate(keys)])
    rows = shared.keep(numbered.select(F.col("row_number").alias("_at"), "row", key.alias("_key")), "numbered")
    before = rows.select((F.col("_at") + 1).alias("_at"), F.col("_key").alias("_last"), F.lit(True).alias("_some"))
    fresh = F.when(F.col("_some") & F.col("_key").eqNullSafe(F.col("_last")), 0).otherwise(1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-rows.count() // n))
    marked = shared.keep(rows.join(before, "_at", "left").select("_at", "row", fresh.alias("_new"), F.floor(F.col("_at") / size).alias("_range")), "runs")
    sums = marked.groupBy("_range").agg(F.sum("_new").alias("_sum"))
    offsets = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_offset"))  # one row for each of n ranges
    inside = F.sum("_new").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(F.broadcast(offsets), "_range").withColumn("_run", F.col("_offset") + inside).select("row.*", "_run")
