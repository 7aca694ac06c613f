"""Sources and sinks: constant rows, generators, files and consumers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared


def constant(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A fixed set of rows."""
    return spark.createDataFrame(list(rows), schema)


def generated(spark: SparkSession, count: int, *columns: Column, partitions: int | None = None) -> DataFrame:
    """``count`` rows computed from ``n`` = 0, 1, 2 ... by column expressions."""
    numbers = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return numbers.withColumnRenamed("id", "n").select(*(columns or ("n",)))


class _Called(DataSourceReader):
    def __init__(self, function: Callable[[int], Iterator[tuple]], parts: int):
        self.function, self.parts = function, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        yield from self.function(partition.value)


def generator(spark: SparkSession, function: Callable[[int], Iterator[tuple]], schema: T.StructType | str, parts: int = 1) -> DataFrame:
    """Rows of a user's generator, called once for each of ``parts`` numbers, on the executors; the end of it ends the part."""
    shared.ship(spark)
    name = f"relplan_generator_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def reader(self, schema):
            return _Called(function, parts)

    spark.dataSource.register(Source)
    return spark.read.format(name).schema(schema).load()


def stream_input(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", **options) -> DataFrame:
    """Rows written by :func:`stream_output`; damaged input fails the query."""
    return spark.read.schema(schema).options(mode="FAILFAST", **options).format(form).load(path)


def stream_output(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """All rows as files below ``path``, visible once complete."""
    df.write.options(**options).format(form).mode(mode).save(path)


def consume(df: DataFrame, consumer: Callable[[T.Row], object]) -> int:
    """Call ``consumer`` on the driver for one row after another until it returns False or 0; the number of calls."""
    calls = 0
    for row in df.toLocalIterator():
        calls += 1
        answer = consumer(row)
        if answer is not None and not answer:
            break
    return calls


def print_rows(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


_UNITS = ("", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
_TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def in_words(n: Column) -> Column:
    """English words of n modulo 1000; zero is "zero"."""
    units, tens = (F.array(*[F.lit(x) for x in xs]) for xs in (_UNITS, _TENS))
    m = (n % 1000).cast("int")
    rest = (m % 100).cast("int")
    small = F.when(rest < 20, F.get(units, rest)).otherwise(F.concat_ws(" ", F.get(tens, (rest / 10).cast("int")), F.nullif(F.get(units, rest % 10), F.lit(""))))
    hundreds = F.when(m >= 100, F.concat(F.get(units, (m / 100).cast("int")), F.lit(" hundred")))
    return F.when(m == 0, F.lit("zero")).otherwise(F.concat_ws(" ", hundreds, F.nullif(small, F.lit(""))))


def records(spark: SparkSession, count: int) -> DataFrame:
    """The seven-column sample table: num, order, num_in_words, digits, value_in_string, some_numeric, some_float."""
    n = F.col("n")
    text = n.cast("string")
    digits = F.when(n == 0, F.array().cast("array<smallint>")).otherwise(F.transform(F.reverse(F.split(text, "")), lambda c: c.cast("smallint")))
    sign = F.when(n % 2 == 1, -1).otherwise(1)
    return generated(spark, count, n.alias("num"), F.lit(0).cast("tinyint").alias("order"), in_words(n).alias("num_in_words"), digits.alias("digits"), F.when(n % 3 != 0, F.lit("value")).alias("value_in_string"), (sign * n).cast("decimal(38,6)").alias("some_numeric"), ((n / 100) * sign).cast("float").alias("some_float"))
