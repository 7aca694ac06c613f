"""The file source and sink as streams: every operator of rows works on them unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """Rows of the files below ``path``, those to come included."""
    reader = spark.readStream.schema(schema).format(form).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def drain(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> None:
    """Append everything there is now to files below ``path``, each input row once across restarts."""
    query = df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Call ``function`` with one batch after another of what there is now; batches keep their number when repeated."""
    query = df.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
