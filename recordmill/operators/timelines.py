"""Carry-forward and interval building over ordered logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.plans.ordered import Running, following, running


def wall_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp's wall-clock fields, in any session time zone."""
    second = F.expr(f"CAST(extract(SECOND FROM `{ts}`) * 1000000 AS BIGINT)")
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return (((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60) * 1_000_000 + second


def carry_forward(lines: DataFrame, order: str, value: Column, name: str, initial: object = "None") -> DataFrame:
    """Last non-null ``value`` at or before each row; ``initial`` before the first."""
    carried = running(lines, order, [Running(name, value, how="last")])
    return carried if initial is None else carried.withColumn(name, F.coalesce(name, F.lit(initial)))


def failed_molecules(growth: DataFrame) -> DataFrame:
    """(pos, molecule): the molecule in work at each growth error."""
    carried = carry_forward(growth, "pos", F.col("molecule"), "current")
    return carried.where("failed").select("pos", F.col("current").alias("molecule"))


def build_intervals(
    events: DataFrame, order: str, worker: Sequence[str], begins: Column, ends: Column, time: str
) -> DataFrame:
    """(worker…, t0, dur, closed): each begin paired with the end that closes it.

    An end closes the latest open begin of its worker, so begins and ends pair
    at equal nesting depth.  A begin that is never closed lasts until the latest
    time in the log.
    """
    worker = list(worker)
    sign = F.when(begins, 1).when(ends, -1).otherwise(0).cast("long")
    marked = events.select(*worker, order, time, sign.alias("sign")).where("sign <> 0")
    nested = running(marked, order, [Running("depth", F.col("sign"))], within=worker)
    level = F.when(F.col("sign") > 0, F.col("depth")).otherwise(F.col("depth") + 1)
    here = F.struct(F.col("sign").alias("sign"), F.col(time).alias("t"))
    paired = following(nested.withColumn("level", level), order, "next", here, within=[*worker, "level"])
    latest = events.select(F.max(time)).scalar()
    closed = F.coalesce(F.col("next.sign") == -1, F.lit(False))
    stop = F.when(closed, F.col("next.t")).otherwise(latest)
    return paired.where("sign > 0").select(
        *worker, order, F.col(time).alias("t0"), (stop - F.col(time)).alias("dur"), closed.alias("closed")
    )
