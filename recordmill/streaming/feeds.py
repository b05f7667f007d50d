"""Pull-based feeding of records: process what is there, stop, resume later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Transform = Callable[[DataFrame], DataFrame]


def parquet_feed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Files of a folder as a stream; ``files_per_batch`` bounds one micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fasta_feed(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Raw FASTA records of new files; the delimiter is restored on every record."""
    from pyspark.sql import functions as F

    lines = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.concat(F.lit(">"), F.regexp_replace("value", "^>|\n$", ""), F.lit("\n")).alias("raw"))


def _writer(feed: DataFrame, transform: Transform, out: str, checkpoint: str):
    return (
        transform(feed)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )


def run_available(feed: DataFrame, transform: Transform, out: str, checkpoint: str) -> None:
    """Process everything available, then stop.

    Started again with the same checkpoint it takes up only unfinished input,
    each record exactly once.
    """
    _writer(feed, transform, out, checkpoint).start().awaitTermination()


def run_for(feed: DataFrame, transform: Transform, out: str, checkpoint: str, seconds: float) -> bool:
    """Like :func:`run_available` with a time limit; True when all input was done.

    On the limit the running batch is dropped uncommitted and redone next time.
    """
    query: StreamingQuery = _writer(feed, transform, out, checkpoint).start()
    finished = bool(query.awaitTermination(seconds))
    if not finished:
        query.stop()
    return finished
