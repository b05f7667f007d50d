"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group.  Groups stand in the order of their text's hash, and
the smallest capacity for which a greedy walk needs no more than the wanted shards is
found by binary search.

The walk runs on a summary whose size does not follow the corpus: hash ranges (cells) with
their totals, and one by one the groups that are large beside a cell.  Where the answer for
a capacity hangs on the inside of a cell, the groups of just those cells are fetched, a few
cells for each cut.  A group that alone reaches an even share of what is left gets a shard of
its own first: no contiguous cut can do better for it, and the others stay even.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.session import materialize

#: Fixed share of a document besides its text.
ROW_BYTES = 16
#: Cells of the summary at most, as a power of two.
MAX_BITS = 22
#: Rows numbered in one window.
SLOT_ROWS = 1 << 16


@dataclass
class Atoms:
    """Totals in order; an atom is one heavy group, or all light groups of a cell."""

    cell: np.ndarray
    light: np.ndarray
    hash: np.ndarray  # of a heavy group
    total: np.ndarray
    inside: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # atom: hashes, ends

    def __post_init__(self) -> None:
        self.ends = np.cumsum(self.total)
        self.starts = self.ends - self.total


def minimax_shards(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    A null text counts as an empty one; size is its UTF-8 bytes plus ``ROW_BYTES``.  Equal
    texts share a shard.  Slots count from 0 without gaps in each shard.  Repeated rows are
    rows of their own; an empty table gives no rows; with fewer groups than shards some
    shards stay empty.  Other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole).alias("hash"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bits = min(MAX_BITS, math.ceil(math.log2(count + 1) / 2) + 5)
    cell = F.shiftright("hash", 64 - bits)
    heavy_over = 8 * total / 2**bits
    groups = groups.withColumn("cell", cell)
    heavy = groups.where(F.col("bytes") > heavy_over).select("cell", "hash", "bytes").collect()  # at most 2**bits / 8

    own, rest, left = [], shards, total
    for group in sorted(heavy, key=lambda g: (-g["bytes"], g["hash"])):
        if rest == 1 or group["bytes"] * rest < left:
            break
        own.append(group["hash"])
        rest, left = rest - 1, left - group["bytes"]
    heavy = [g for g in heavy if g["hash"] not in set(own)]
    light = groups.where(F.col("bytes") <= heavy_over)
    summary = light.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).toPandas()
    atoms = _atoms(heavy, summary)
    largest = max([0, *(g["bytes"] for g in heavy), *summary["largest"].tolist()])

    def fetch(wanted: list[int]) -> None:
        cells = groups.sparkSession.createDataFrame([(int(atoms.cell[k]),) for k in wanted], "cell bigint")
        found = light.join(F.broadcast(cells), "cell").select("cell", "hash", "bytes").toPandas()
        found = found.sort_values(["cell", "hash"])
        for k in wanted:
            own_groups = found[found["cell"] == atoms.cell[k]]
            atoms.inside[k] = own_groups["hash"].to_numpy(), atoms.starts[k] + own_groups["bytes"].cumsum().to_numpy()

    cuts = smallest_capacity(atoms, rest, largest, fetch)[1] if len(atoms.total) else []
    heavy_rows = groups.sparkSession.createDataFrame([(int(g["hash"]),) for g in heavy], "hash bigint")
    placed = rows.withColumn("cell", cell).join(F.broadcast(heavy_rows.withColumn("heavy", F.lit(True))), "hash", "left")
    order = F.struct(F.col("cell"), F.col("heavy").isNull().cast("int"), F.col("hash"))
    shard: Column = F.lit(0)
    for a, b, c in cuts:
        bound = F.struct(F.lit(a).cast("long"), F.lit(b).cast("int"), F.lit(c).cast("long"))
        shard = shard + (order >= bound).cast("int")
    for k, alone in enumerate(own):
        shard = F.when(F.col("hash") == F.lit(alone), F.lit(shards - 1 - k)).otherwise(shard)
    return _slotted(placed.withColumn("shard", shard.cast("int")), groups)


def _atoms(heavy: list, summary) -> Atoms:
    parts = [(g["cell"], 0, g["hash"], g["bytes"]) for g in heavy]
    cell = np.array([p[0] for p in parts] + summary["cell"].tolist(), np.int64)
    light = np.array([0] * len(parts) + [1] * len(summary), np.int64)
    key = np.array([p[2] for p in parts] + [-(2**63)] * len(summary), np.int64)
    total = np.array([p[3] for p in parts] + summary["bytes"].tolist(), np.int64)
    order = np.lexsort((key, light, cell))
    return Atoms(cell[order], light[order], key[order], total[order])


def _walk(atoms: Atoms, shards: int, capacity: int):
    """Greedy walk: for each cut the bounds of its place, and the atoms that would settle it."""
    total = int(atoms.ends[-1])
    places, unknown = [(0, 0)], set()

    def settle(target: int) -> tuple[int, int]:
        k = int(np.searchsorted(atoms.ends, target, "right"))
        low, high = int(atoms.starts[k]), int(atoms.starts[k])
        if k in atoms.inside:
            ends = atoms.inside[k][1]
            at = int(np.searchsorted(ends, target, "right"))
            low = high = int(ends[at - 1]) if at else low
        elif atoms.light[k] and target > low:
            high = target
            unknown.add(k)
        return low, high

    for _ in range(shards):
        low, high = places[-1]
        if low + capacity >= total:
            places.append((total, total))
            break
        # Whatever lies between the two ends is fetched as well: the true cut is one of it.
        first = settle(low + capacity)
        last = settle(high + capacity) if high != low and high + capacity < total else first
        if high + capacity >= total:
            last = (total, total)
        if last[1] > first[0]:
            a, b = np.searchsorted(atoms.ends, [low + capacity, min(high + capacity, total - 1)], "right")
            unknown.update(k for k in range(int(a), int(b) + 1) if atoms.light[k] and k not in atoms.inside)
        places.append((first[0], last[1]))
    return places, sorted(unknown)


def smallest_capacity(atoms: Atoms, shards: int, largest: int, fetch) -> tuple[int, list[tuple[int, int, int]]]:
    """(capacity, cuts): a cut is the order key of the first group behind it."""
    total = int(atoms.ends[-1])
    low = max(-(-total // shards), largest) - 1  # too small
    high = low + 1 + largest  # always enough

    def feasible(capacity: int) -> bool:
        while True:
            places, unknown = _walk(atoms, shards, capacity)
            if places[-1][0] >= total:
                return True
            if places[-1][1] < total:
                return False
            fetch(unknown)

    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle, high)
    while True:  # the cuts themselves must be exact
        places, unknown = _walk(atoms, shards, high)
        if all(a == b for a, b in places):
            break
        fetch(unknown)
    cuts = []
    for place, _ in places[1:]:
        if place >= total:
            break
        k = int(np.searchsorted(atoms.ends, place, "right"))
        at = place - int(atoms.starts[k])
        key = int(atoms.hash[k])
        if at:
            hashes, ends = atoms.inside[k]
            key = int(hashes[np.searchsorted(ends, place, "right")])
        cuts.append((int(atoms.cell[k]), int(atoms.light[k]), key))
    return high, cuts


def _slotted(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Number the rows of each shard without a window over a whole shard."""
    crowded = groups.groupBy("cell").agg((F.sum("rows") / SLOT_ROWS).cast("int").alias("extra"))
    crowded = crowded.where("extra > 0")
    placed = placed.join(crowded, "cell", "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("extra", F.lit(0)) + 1))
    keys = ["shard", "cell", "part"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("rows"))
    offset = F.sum("rows").over(_before("shard", "cell", "part"))
    offsets = counts.select(*keys, F.coalesce(offset, F.lit(0)).alias("offset"))
    numbered = placed.withColumn("place", F.row_number().over(_window(keys)))
    slot = (F.col("offset") + F.col("place") - 1).cast("long")
    return numbered.join(offsets, keys).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def _before(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _window(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("hash", "doc_id")
