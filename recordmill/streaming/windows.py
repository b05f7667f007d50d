"""Event-time windows over a stream, with a watermark and the state store.

A window is emitted once, when the watermark has passed its end; rows behind the watermark
are late and dropped.  Rows without a time belong to no window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordmill.streaming.feeds import parquet_feed, run_available

#: Sessions of one batch are merged before the shuffle, so a hot key sends few rows.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
LAST_TIME = "9999-01-01 00:00:00"


def tumbling(feed: DataFrame, time: str, size: str, delay: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """(keys…, start_us, end_us, aggregates…) of windows of one ``size``, aligned at 1970."""
    return _windowed(feed, time, F.window(time, size), delay, keys, aggregates)


def sessions(feed: DataFrame, time: str, gap: str, delay: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """(keys…, start_us, end_us, aggregates…) of sessions; one ends ``gap`` after its last row."""
    return _windowed(feed, time, F.session_window(time, gap), delay, keys, aggregates)


def _windowed(feed: DataFrame, time: str, window: Column, delay: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    grouped = feed.withWatermark(time, delay).groupBy(window.alias("__window"), *keys).agg(*aggregates)
    bounds = [F.unix_micros(f"__window.{c}").alias(f"{c}_us") for c in ("start", "end")]
    return grouped.select(*keys, *bounds, *[c for c in grouped.columns if c not in {"__window", *keys}])


def closable_feed(spark: SparkSession, path: str, closing: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """The files of ``path`` as a stream that :func:`close` can end."""
    spark.createDataFrame([], schema).write.mode("append").parquet(closing)
    return parquet_feed(spark, path, schema, files_per_batch).unionByName(parquet_feed(spark, closing, schema))


def close(spark: SparkSession, closing: str, schema: StructType, time: str) -> None:
    """Lets the watermark pass every window: one row of nothing but a time that nothing follows.

    That row's own window stays open, so it is never emitted.  Rows fed afterwards are late.
    """
    last = F.lit(LAST_TIME).cast(schema[time].dataType)
    row = spark.range(1).select(*[(last if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    row.write.mode("append").parquet(closing)


def run_windows(
    spark: SparkSession,
    feed: Callable[[], DataFrame],
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> None:
    """Feed what is there and stop; started again with the same checkpoint it goes on."""
    before = spark.conf.get(MERGE_FIRST, "false")
    spark.conf.set(MERGE_FIRST, "true")
    try:
        run_available(feed(), transform, out, checkpoint)
    finally:
        spark.conf.set(MERGE_FIRST, before)
