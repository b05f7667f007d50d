"""Running aggregates over a global record order without a one-task window.

A plain ``sum(x) OVER (ORDER BY pos)`` sends every row to one task, and
``OVER (PARTITION BY key ORDER BY pos)`` does the same to a hot key.  Here the
order is cut into buckets of consecutive positions:

1. rows are hashed on (key, bucket) and a window runs inside each bucket;
2. each bucket is reduced to one row, and a window over those rows gives what
   lies before the bucket;
3. both are joined on (key, bucket), which reuses the hashing of step 1.

Positions are unique integers, so a bucket never holds more than
``BUCKET_ROWS`` rows whatever the key distribution, and the window of step 2
sees one row per bucket.  Buckets are a function of the position alone, which
keeps retried tasks and reused branches consistent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.session import materialize

BUCKET_ROWS = 1 << 17


@dataclass(frozen=True)
class Running:
    """One running aggregate: output ``name`` over ``value``.

    ``how`` is sum, min, max or last (last non-null value).  ``exclusive``
    leaves the current row out.  ``total`` names an extra column holding the
    sum over the whole key.
    """

    name: str
    value: Column
    how: str = "sum"
    exclusive: bool = False
    total: str | None = None


def position_bucket(order: str, rows: int = BUCKET_ROWS) -> Column:
    return F.expr(f"`{order}` div {rows}")


def running(
    df: DataFrame,
    order: str,
    specs: Sequence[Running],
    *,
    within: Sequence[str] = (),
    bucket: Sequence[str] = (),
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
    shuffle: bool = True,
) -> DataFrame:
    """Add every running aggregate of ``specs`` to ``df``.

    ``order`` is a unique, non-null integer column; ``within`` columns must be
    non-null (a computed key is best wrapped in ``coalesce``: a null test on it would
    evaluate it twice).  ``bucket`` may name existing columns that already cut the order
    into bounded runs (for example file and split start).  ``shuffle=False`` says that
    the rows are already hashed on within + bucket by an earlier call.
    """
    within, keep = list(within), list(df.columns)
    staged = df
    if not bucket:
        staged = staged.withColumn("__bucket", position_bucket(order, bucket_rows))
        bucket = ["__bucket"]
    bucket = list(bucket)
    for i, spec in enumerate(specs):
        staged = staged.withColumn(f"__v{i}", spec.value)
    keys = within + bucket
    # One narrow shuffle feeds both the local windows and the bucket totals.
    # The null test is what the join below implies; stating it here keeps the
    # two branches identical.
    for key in keys:
        staged = staged.where(F.col(key).isNotNull())
    if shuffle:
        staged = staged.repartition(*keys)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    first_row, before, here = Window.unboundedPreceding, -1, Window.currentRow
    local = Window.partitionBy(*keys).orderBy(direction(order))
    # A hash over every column keeps all of them in this branch: both branches
    # then read one exchange and the input is scanned and hashed only once.
    totals = staged.groupBy(*keys).agg(
        F.max(F.xxhash64(*staged.columns)).alias("__check"),
        *[_bucket_value(spec, f"__v{i}", order, descending).alias(f"__t{i}") for i, spec in enumerate(specs)],
    )
    top = Window.partitionBy(*within).orderBy(*[direction(b) for b in bucket])
    whole = Window.partitionBy(*within)
    offsets = totals.where("__check IS NOT NULL").select(
        *keys,
        *[
            _aggregate(spec, F.col(f"__t{i}")).over(top.rowsBetween(first_row, before)).alias(f"__o{i}")
            for i, spec in enumerate(specs)
        ],
        *[
            F.sum(f"__t{i}").over(whole).alias(f"__w{i}")
            for i, spec in enumerate(specs)
            if spec.total
        ],
    )
    joined = staged.select(
        "*",
        *[
            _aggregate(spec, F.col(f"__v{i}"))
            .over(local.rowsBetween(first_row, before if spec.exclusive else here))
            .alias(f"__l{i}")
            for i, spec in enumerate(specs)
        ],
    ).join(offsets, keys)
    out = [F.col(c) for c in keep]
    for i, spec in enumerate(specs):
        out.append(_combine(spec, F.col(f"__l{i}"), F.col(f"__o{i}")).alias(spec.name))
        if spec.total:
            out.append(F.col(f"__w{i}").alias(spec.total))
    return joined.select(*out)


def ordinal(
    df: DataFrame, order: str, name: str = "ordinal", *, within: Sequence[str] = (), total: str | None = None, **kw
) -> DataFrame:
    """Zero-based dense ordinal of each row in the order, per ``within`` key."""
    one = Running(name, F.lit(1).cast("long"), exclusive=True, total=total)
    return running(df, order, [one], within=within, **kw)


def dense_positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``, whatever its values.

    Rows are range-partitioned by the order, so a partition's count places the next one;
    within its partition a row is counted in bounded runs.  Ties are placed arbitrarily.
    """
    spread = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "positions")
    part, local = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    counts = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per range partition.
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = spread.withColumn("__part", part).withColumn("__local", local).join(F.broadcast(starts), "__part")
    return placed.select(*df.columns, (F.col("__before") + F.col("__local")).alias(name))


def following(df: DataFrame, order: str, name: str, value: Column, *, within: Sequence[str] = (), **kw) -> DataFrame:
    """Value of the next row of the same key: ``lead(value)`` safe for hot keys."""
    spec = Running(name, value, how="last", exclusive=True)
    return running(df, order, [spec], within=within, descending=True, **kw)


def _aggregate(spec: Running, value: Column) -> Column:
    if spec.how == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.how](value)


def _bucket_value(spec: Running, value: str, order: str, descending: bool) -> Column:
    if spec.how == "last":
        present = F.when(F.col(value).isNotNull(), F.col(order))
        return F.min_by(value, present) if descending else F.max_by(value, present)
    return _aggregate(spec, F.col(value))


def _combine(spec: Running, local: Column, offset: Column) -> Column:
    if spec.how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0))
    if spec.how == "last":
        return F.coalesce(local, offset)
    return (F.least if spec.how == "min" else F.greatest)(local, offset)
