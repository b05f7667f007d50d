"""Cutting an ordered record set into parts of similar byte size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.plans.ordered import BUCKET_ROWS, Running, running
from recordmill.session import materialize

FAN_IN = 64
WINDOW_LIMIT = 1 << 20
STEPS = "chunk BIGINT, low BIGINT, carry BIGINT, closed BIGINT, moving BOOLEAN"


def byte_split(records: DataFrame, order: str, length: str, splits: int, name: str = "part") -> DataFrame:
    """Part of each record: the first i with offset < (i + 1) * total div splits."""
    sized = running(
        records.select(order, length), order, [Running("off", F.col(length), exclusive=True, total="whole")]
    )
    s = int(splits)
    # Decimal products only where offset times splits could pass 63 bits.
    fits = f"whole <= {(2**63 - 1) // (s + 1)}"
    guess = f"CASE WHEN {fits} THEN (off * {s}L) div whole ELSE (CAST(off AS DECIMAL(20,0)) * {s}) div whole END"
    edge = (
        f"CASE WHEN {fits} THEN ((guess + 1) * whole) div {s}L"
        f" ELSE (CAST(guess + 1 AS DECIMAL(20,0)) * whole) div {s} END"
    )
    return sized.withColumn("guess", F.expr(guess)).select(
        order,
        F.col(length),
        F.col("off").alias("byte_off"),
        F.expr(f"CASE WHEN off < {edge} THEN guess ELSE guess + 1 END").alias(name),
    )


def greedy_pack(records: DataFrame, order: str, length: str, threshold: int, name: str = "block") -> DataFrame:
    """(order, length, block): fill a block until it reaches ``threshold`` bytes, then reset.

    Each record depends on all before it, but only through the bytes waiting in
    the open block.  A chunk of consecutive records is therefore a step function
    from that carry to (carry after, blocks closed).  Chunks compute their step
    functions in parallel, a tree composes them, and a walk down the tree hands
    every chunk its real carry.  No task sees more than a chunk or one tree node.

    Blocks of more than about a million records make the step functions long;
    there are few such blocks, and their ends are looked up one by one instead.
    """
    threshold = int(threshold)
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    sized = records.select(F.col(order).alias("pos"), F.col(length).cast("long").alias("len"))
    seen = sized.agg(F.max("pos"), F.min("pos"), F.sum("len"), F.count("*")).first()
    last, first, whole, count = (v or 0 for v in seen)
    if count and threshold > WINDOW_LIMIT * max(whole / count, 1):
        packed = _pack_by_lookup(sized, threshold, whole)
    else:
        packed = _pack_by_scan(sized, threshold, first, last)
    return packed.select(F.col("pos").alias(order), F.col("len").alias(length), F.col("block").alias(name))


def pack_into(records: DataFrame, order: str, length: str, splits: int, name: str = "part") -> DataFrame:
    """Greedy parts with threshold = total bytes div splits."""
    whole = records.agg(F.sum(length)).first()[0] or 0
    return greedy_pack(records, order, length, max(whole // int(splits), 1), name)


def _pack_by_scan(sized: DataFrame, threshold: int, first: int, last: int) -> DataFrame:
    chunked = sized.withColumn("chunk", F.expr(f"(pos - {first}L) div {BUCKET_ROWS}"))
    chunks = (last - first) // BUCKET_ROWS + 1
    if chunks == 1:
        entries = chunked.withColumn("carry", F.lit(0)).withColumn("base", F.lit(0))
        return _assign(entries, threshold)
    levels = [materialize(_chunk_steps(chunked, threshold), "pack-steps")]
    while chunks > FAN_IN:
        levels.append(materialize(_compose_level(levels[-1]), "pack-steps"))
        chunks = -(-chunks // FAN_IN)
    entries = _walk(levels[-1].withColumn("node", F.lit(0).cast("long")), root=True)
    for level in reversed(levels[:-1]):
        parents = entries.withColumnRenamed("chunk", "node")
        below = level.withColumn("node", F.expr(f"chunk div {FAN_IN}")).join(
            parents.withColumnsRenamed({"carry": "in_carry", "base": "in_base"}), "node"
        )
        entries = _walk(below)
    return _assign(chunked.join(entries, "chunk"), threshold)


def _chain(lens: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, and for a fresh block at each record: final carry, blocks closed."""
    prefix = np.concatenate([[0], np.cumsum(lens)])
    # First record start after the block opened at i is full; itself when it never fills.
    jump = np.searchsorted(prefix, prefix + threshold, side="left")
    here = np.arange(len(prefix))
    open_end = jump == len(prefix)
    jump = np.where(open_end, here, jump)
    closed = np.where(open_end, 0, 1)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        closed = closed + closed[jump]
        jump = further
    return prefix, prefix[-1] - prefix[jump], closed


def _chunk_steps(chunked: DataFrame, threshold: int) -> DataFrame:
    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lens = rows.sort_values("pos")["len"].to_numpy()
        prefix, carry, closed = _chain(lens, threshold)
        # Record j is the first to fill the open block for carries from
        # threshold - prefix[j + 1] up to threshold - prefix[j].
        fills = np.flatnonzero(prefix[:-1] < threshold)
        low = np.maximum(threshold - prefix[fills + 1], 0)
        table = _table(low[::-1], carry[fills + 1][::-1], closed[fills + 1][::-1] + 1, False)
        if prefix[-1] < threshold:
            table = pd.concat([_table([0], [prefix[-1]], [0], True), table])
        return _tidy(table, key[0])

    return chunked.groupBy("chunk").applyInPandas(steps, STEPS)


def _table(low, carry, closed, moving) -> pd.DataFrame:
    """Rows of a step function; a moving row adds ``carry`` to the incoming carry."""
    return pd.DataFrame({"low": low, "carry": carry, "closed": closed, "moving": moving})


def _tidy(table: pd.DataFrame, chunk: int) -> pd.DataFrame:
    table = table.drop_duplicates("low", keep="last")
    body = table[["carry", "closed", "moving"]]
    table = table[~(body == body.shift()).all(axis=1).to_numpy()]
    return table.assign(chunk=chunk)[["chunk", "low", "carry", "closed", "moving"]]


def _apply(table: pd.DataFrame, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table["low"].to_numpy(), carry, side="right") - 1
    out = table["carry"].to_numpy()[at] + np.where(table["moving"].to_numpy()[at], carry, 0)
    return out, table["closed"].to_numpy()[at]


def _compose(first: pd.DataFrame, then: pd.DataFrame) -> pd.DataFrame:
    """Step function of running ``first`` and then ``then``."""
    fixed = first[~first["moving"]]
    carry, closed = _apply(then, fixed["carry"].to_numpy())
    table = _table(fixed["low"].to_numpy(), carry, fixed["closed"].to_numpy() + closed, False)
    if len(fixed) < len(first):
        shift = first["carry"].iloc[0]
        stop = fixed["low"].iloc[0] if len(fixed) else np.iinfo(np.int64).max
        moved = then.assign(low=np.maximum(then["low"] - shift, 0))
        moved = moved[moved["low"] < stop]
        moved = moved.assign(carry=moved["carry"] + np.where(moved["moving"], shift, 0))
        table = pd.concat([moved[["low", "carry", "closed", "moving"]], table])
    return table


def _compose_level(steps: DataFrame) -> DataFrame:
    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        result = None
        for _, part in rows.sort_values(["chunk", "low"]).groupby("chunk"):
            part = part.drop(columns=["chunk", "node"])
            result = part if result is None else _tidy(_compose(result, part), 0).drop(columns="chunk")
        return _tidy(result, key[0])

    grouped = steps.withColumn("node", F.expr(f"chunk div {FAN_IN}"))
    return grouped.groupBy("node").applyInPandas(compose, STEPS)


def _walk(steps: DataFrame, root: bool = False) -> DataFrame:
    """(chunk, carry, base): what each child of a node starts with."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        carry, base = (0, 0) if root else (rows["in_carry"].iloc[0], rows["in_base"].iloc[0])
        out = []
        for chunk, part in rows.sort_values(["chunk", "low"]).groupby("chunk"):
            out.append((chunk, carry, base))
            after, closed = _apply(part, np.array([carry]))
            carry, base = int(after[0]), base + int(closed[0])
        return pd.DataFrame(out, columns=["chunk", "carry", "base"])

    return steps.groupBy("node").applyInPandas(walk, "chunk BIGINT, carry BIGINT, base BIGINT")


def _assign(entered: DataFrame, threshold: int) -> DataFrame:
    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        prefix = np.concatenate([[0], np.cumsum(rows["len"].to_numpy())])
        blocks = np.zeros(len(rows), dtype=np.int64)
        start, need, block = 0, threshold - int(rows["carry"].iloc[0]), int(rows["base"].iloc[0])
        while start < len(rows):
            stop = int(np.searchsorted(prefix, prefix[start] + need, side="left"))
            blocks[start:stop] = block
            start, need, block = max(stop, start + 1), threshold, block + 1
        return pd.DataFrame({"pos": rows["pos"], "len": rows["len"], "block": blocks})

    return entered.groupBy("chunk").applyInPandas(number, "pos BIGINT, len BIGINT, block BIGINT")


def _pack_by_lookup(sized: DataFrame, threshold: int, whole: int) -> DataFrame:
    ends = running(sized, "pos", [Running("end", F.col("len"))])
    ends = materialize(ends.repartitionByRange("end").sortWithinPartitions("end"), "pack-ends")
    stops, start = [], 0
    while start + threshold <= whole:
        # Row groups below the target are skipped by their statistics.
        stop = ends.where(F.col("end") >= start + threshold).agg(F.min_by("pos", F.struct("end", "pos")), F.min("end"))
        pos, start = stop.first()
        stops.append((pos,))
    marks = sized.sparkSession.createDataFrame(stops, "pos BIGINT").withColumn("full", F.lit(1).cast("long"))
    flagged = ends.drop("end").join(marks, "pos", "left")
    full = F.coalesce("full", F.lit(0).cast("long"))
    return running(flagged, "pos", [Running("block", full, exclusive=True)])


def pack_records(
    records: DataFrame, order: str, raw: str, threshold: int, encode: Callable[[bytes], bytes] | None = None
) -> DataFrame:
    """(block, records, payload): the packed records joined into block payloads.

    A block holds ``threshold`` bytes plus at most one record.
    """
    sized = records.select(order, F.octet_length(raw).cast("long").alias("len"))
    packed = greedy_pack(sized, order, "len", threshold).drop("len")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["payload"] = batch["payload"].map(bytes).map(encode)
            yield batch

    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, raw))), lambda x: x[raw])
    blocks = records.join(packed, order).groupBy("block").agg(
        F.count("*").alias("records"), F.encode(F.array_join(parts, ""), "UTF-8").alias("payload")
    )
    return blocks.mapInPandas(build, blocks.schema) if encode else blocks
