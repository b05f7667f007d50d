"""Masks: intervals of low complexity, merged mask lists, and words outside of them.

A mask is a row (id, start, stop): 0-based, half-open positions among the letters of a
record, as in :func:`recordmill.operators.similarity.words`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters of one bin of the interval join.
BIN_LETTERS = 1 << 10


def low_complexity(
    records: DataFrame, id_column: str, text: str, *, window: int = 12, word: int = 1, least: int = 14
) -> DataFrame:
    """(id, start, stop): where words repeat within a window, overlapping windows merged.

    A window of ``window`` consecutive words of ``word`` letters scores the number of its pairs
    of equal words: single letters find runs and short repeats, three letters with a window of
    62 longer ones.  Windows that score ``least`` or more are masked.  A record without text, or
    with fewer words than a window, has no mask.
    """
    upper = np.zeros(256, np.uint8)
    for letter in range(26):
        upper[[65 + letter, 97 + letter]] = 65 + letter

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, starts, stops = [], [], []
            for row, body in enumerate(batch.column("text")):
                data = upper[np.frombuffer(body.as_buffer(), np.uint8)]
                first, last = _intervals(data[data > 0], window, word, least)
                owners.append(np.full(len(first), row))
                starts.append(first)
                stops.append(last)
            join = lambda parts: np.concatenate(parts or [np.zeros(0, np.int64)]).astype(np.int64)
            columns = [batch.column("id").take(pa.array(join(owners))), pa.array(join(starts)), pa.array(join(stops))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "stop"])

    narrow = records.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"id {kind}, start BIGINT, stop BIGINT")


def _intervals(letters: np.ndarray, window: int, word: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    count = len(letters) - word + 1
    if count < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = letters
    if word > 1:
        codes = np.zeros(count, np.int64)
        for i in range(word):
            codes = codes * 26 + (letters[i : i + count] - 65)
    # Moving the window by one word adds its pairs with the words before it, and takes away
    # those of the word left behind.
    back, ahead = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for step in range(1, window):
        same = codes[step:] == codes[:-step]
        back[step:] += same
        ahead[:-step] += same
    back[window:] -= ahead[:-window]
    masked = np.flatnonzero(np.cumsum(back)[window - 1 :] >= least)
    if not len(masked):
        return masked, masked
    length = window + word - 1
    fresh = np.flatnonzero(np.diff(masked) > length) + 1
    return masked[np.concatenate([[0], fresh])], masked[np.concatenate([fresh - 1, [-1]])] + length


def merged(masks: DataFrame) -> DataFrame:
    """(id, start, stop): overlapping and touching intervals of a record as one; empty ones go."""
    order = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = masks.select("id", "start", "stop").where("stop > start").distinct()
    runs = kept.withColumn("fresh", fresh).withColumn("run", run)
    return runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def unmasked(found: DataFrame, masks: DataFrame, size: int, *, bin_letters: int = BIN_LETTERS) -> DataFrame:
    """Rows of ``found`` (id, at, ...) whose ``size`` letters from ``at`` meet no mask.

    An interval join in bins: a mask is listed once for every bin in which a word that meets it
    can start, and a word looks into its own bin only, so a record of any length and any number of
    masks is spread over tasks.
    """
    bin_of = lambda at: F.floor(at / bin_letters).cast("long")
    first = F.greatest(F.col("start") - (size - 1), F.lit(0))
    listed = merged(masks).select(
        F.col("id").alias("__id"),
        F.col("start").alias("__start"),
        F.col("stop").alias("__stop"),
        F.explode(F.sequence(bin_of(first), bin_of(F.col("stop") - 1))).alias("__bin"),
    )
    meets = (
        (F.col("id") == F.col("__id"))
        & (bin_of(F.col("at")) == F.col("__bin"))
        & (F.col("at") < F.col("__stop"))
        & (F.col("at") + size > F.col("__start"))
    )
    return found.join(listed, meets, "left_anti")
