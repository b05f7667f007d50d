"""Credit-based systematic sampling in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.operators.records import in_range
from recordmill.plans.ordered import Running, position_bucket, running


def credit_sample_flags(
    records: DataFrame, order: str, length: str, samples: int, low: int = 1, high: int = 2**31 - 1
) -> DataFrame:
    """(order, selected) for every record; an empty one is never selected or counted.

    One credit is there at the start and every record adds samples / total.  A
    record in range is taken, and a credit spent, when a whole credit is there.
    With ``A(i) = i * samples div total + 1`` credits earned and ``N(i)`` records
    in range so far, the number taken is
    ``S(i) = N(i) + min(0, min over j <= i of A(j) - N(j))``; record i is taken
    when S grows.  Both running values come from bucketed prefix sums.
    """
    # Flags instead of a filter: a filter on a computed length would be pushed
    # down and have the length computed twice.
    full = (F.col(length) > 0).cast("long")
    fit = (in_range(length, max(low, 1), high)).cast("long")
    rows = records.select(order, full.alias("full"), fit.alias("fit"), position_bucket(order).alias("__b"))
    counted = running(
        rows,
        order,
        [Running("i", F.col("full"), exclusive=True, total="n"), Running("fits", F.col("fit"))],
        bucket=["__b"],
    )
    # Decimal products only where position times samples could pass 63 bits.
    due = (
        f"CASE WHEN n <= {(2**63 - 1) // max(int(samples), 1)} THEN (i * {int(samples)}L) div n"
        f" ELSE (CAST(i AS DECIMAL(20,0)) * {int(samples)}) div n END"
    )
    slack = F.when(F.col("full") == 1, F.expr(f"{due} + 1 - fits"))
    scanned = running(
        counted.withColumn("slack", slack),
        order,
        [Running("low", F.col("slack"), "min"), Running("low_before", F.col("slack"), "min", exclusive=True)],
        bucket=["__b"],
        shuffle=False,
    )
    taken = F.col("fits") + F.least(F.lit(0), F.coalesce("low", F.lit(0)))
    taken_before = F.col("fits") - F.col("fit") + F.least(F.lit(0), F.coalesce("low_before", F.lit(0)))
    return scanned.select(order, (taken > taken_before).alias("selected"))


def credit_sample(records: DataFrame, order: str, length: str, samples: int, **bounds: int) -> DataFrame:
    """The sampled records."""
    flags = credit_sample_flags(records, order, length, samples, **bounds)
    return records.join(flags.where("selected"), order, "left_semi")


def credit_sample_rest(records: DataFrame, order: str, length: str, samples: int, **bounds: int) -> DataFrame:
    """Every record that was not sampled."""
    flags = credit_sample_flags(records, order, length, samples, **bounds)
    return records.join(flags.where("selected"), order, "left_anti")
