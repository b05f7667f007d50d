"""Length reports, histograms, ordering, grouping, first-wins and name joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.text import relative_height
from recordmill.plans.ordered import Running, ordinal, running


def length_report(records: DataFrame, id_column: str, length: Column) -> DataFrame:
    """(id, length): one row per record."""
    return records.select(F.col(id_column).alias("id"), length.alias("length"))


def in_range(length: Column | str, low: int = 1, high: int = 2**31 - 1) -> Column:
    return (F.col(length) if isinstance(length, str) else length).between(low, high)


def range_summary(records: DataFrame, length: Column, low: int = 1, high: int = 2**31 - 1) -> DataFrame:
    """(total, in_bounds) over the non-empty records."""
    return (
        records.select(length.alias("n"))
        .where("n > 0")
        .agg(F.count("*").alias("total"), F.count_if(in_range("n", low, high)).alias("in_bounds"))
    )


def length_histogram(records: DataFrame, length: Column) -> DataFrame:
    """(bin, length, count, ratio): bin = length - 1, ratio to the fullest bin.

    A record of length zero fails the job.
    """
    bins = records.select(length.alias("length")).groupBy("length").agg(F.count("*").alias("count"))
    top = bins.select(F.max("count")).scalar()
    bin_label = F.when(F.col("length") > 0, F.col("length") - 1).otherwise(
        F.raise_error(F.lit("record without residues")).cast("long")
    )
    return bins.select(
        bin_label.alias("bin"), "length", "count", relative_height("count", top).alias("ratio")
    )


def first_k_per_bin(
    records: DataFrame, order: str, length: str, *, height: int, stride: int = 1, max_length: int | None = None
) -> DataFrame:
    """First floor(count / max * height) records of each selected length bin.

    Bins are labelled length - 1; every ``stride``-th bin below ``max_length``
    is kept.  The rank inside a bin is a running count, so a bin holding most of
    the records is still spread over many tasks.
    """
    # Rank, bin size and bin label all come out of one shuffle, which the fullest
    # bin is read from as well.  The label is carried as a running value because
    # a filter on the length itself would be pushed below that shuffle.
    one = F.lit(1).cast("long")
    ranked = running(
        records.select(order, length),
        order,
        [Running("__rank", one, exclusive=True, total="__count"), Running("__bin", F.col(length) - 1, "max")],
        within=[length],
    )
    whole_row = F.struct("__count", F.xxhash64(*ranked.columns).alias("row"))
    top = ranked.select(F.max(whole_row)["__count"]).scalar()
    chosen = F.col("__bin") % stride == 0
    if max_length is not None:
        chosen &= F.col("__bin") < max_length
    kept = ranked.where(chosen & (F.col("__rank") < F.floor(F.col("__count") * height / top)))
    if set(records.columns) == {order, length}:
        return kept.select(*records.columns)
    return records.join(kept.select(order), order, "left_semi")


def longest_first(records: DataFrame, order: str, length: str, name: str = "rank") -> DataFrame:
    """1-based rank by length, longest first, ties in input order.

    Rank = records that are longer + place among those of equal length: no
    global sort, and one hot length cannot overload a task.
    """
    sizes = records.groupBy(length).agg(F.count("*").alias("__same"))
    longer = running(sizes, length, [Running("__longer", F.col("__same"), exclusive=True)], descending=True)
    placed = ordinal(records, order, "__place", within=[length])
    return placed.join(longer.drop("__same"), length).select(
        *records.columns, (F.col("__longer") + F.col("__place") + 1).alias(name)
    )


def sort_longest_first(records: DataFrame, order: str, length: str) -> DataFrame:
    """The records themselves in that order (range-partitioned sort)."""
    return records.orderBy(F.desc(length), order)


def fixed_groups(records: DataFrame, order: str, size: int, name: str = "part") -> DataFrame:
    """Consecutive groups of ``size`` records."""
    placed = ordinal(records, order, "__i")
    return placed.withColumn(name, F.expr(f"__i div {int(size)}")).drop("__i")


def first_seen(records: DataFrame, order: str, key: Column) -> DataFrame:
    """(first, copies): position of the first record of every key.

    The key is hashed to 32 bytes before the shuffle and counted map-side, so
    neither long keys nor a very frequent one travel in full.
    """
    hashed = records.select(F.sha2(key.cast("binary"), 256).alias("digest"), F.col(order).alias("at"))
    return hashed.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("copies"))


def distinct_first(records: DataFrame, order: str, key: Column) -> DataFrame:
    """The first record of every key."""
    first = first_seen(records, order, key).select(F.col("first").alias(order))
    return records.join(first, order, "left_semi")


def duplicates(records: DataFrame, order: str, key: Column) -> DataFrame:
    """(order, first): every later record and the record it repeats."""
    first = first_seen(records, order, key).where("copies > 1")
    hashed = records.select(order, F.sha2(key.cast("binary"), 256).alias("digest"))
    return hashed.join(first, "digest").where(F.col(order) > F.col("first")).select(order, "first")


def named(records: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Records whose name is in the set."""
    return records.join(names.select(column), column, "left_semi")


def not_named(records: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    return records.join(names.select(column), column, "left_anti")


def cyclic_zip(records: DataFrame, order: str, cycle: DataFrame, cycle_order: str) -> DataFrame:
    """Pair record i with row i mod n of ``cycle``, columns prefixed ``cycle_``.

    The pairing is an equi-join on the slot, so each record meets one row.
    """
    wheel = ordinal(cycle, cycle_order, "slot").select("slot", *[F.col(c).alias(f"cycle_{c}") for c in cycle.columns])
    count = cycle.select(F.count("*")).scalar()
    placed = ordinal(records, order, "i").withColumn("slot", F.col("i") % count)
    return placed.join(wheel, "slot").drop("slot")


def per_worker_counts(records: DataFrame, worker: Column) -> DataFrame:
    return records.groupBy(worker.alias("worker")).agg(F.count("*").alias("records"))
