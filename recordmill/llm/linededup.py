"""Line deduplication with a sharded minimal perfect hash.

1. Tasks cut texts at line breaks, hash the keys of long lines twice (128 bits) and emit each
   hash once per document.  Grouping gives the number of documents of every distinct line
   and the largest id holding it.  Lines stay where they are; only hashes are shuffled.
2. Lines of fewer than ``min_docs`` documents can never be dropped.  The others are dealt by
   hash into shards of about ``SHARD_KEYS`` keys.  Each shard gets a minimal perfect hash
   (levels of bits; a key takes the first level where no other key shares its bit, and its
   number is the count of bits before it), which indexes arrays of fingerprints, document
   counts and keepers without a gap.
3. Documents probe these arrays.  A task hashes the lines of a run of documents, takes the
   shards one after another from the shared folder, and compares fingerprints; no line is
   joined.  A worker holds at most ``SHARDS_HELD`` shards.

A line is known by 128 hash bits: one half finds its place, the other is the fingerprint.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recordmill.llm.textarrays import gathered, lower_ascii, map_tables, mixed, prepare, span_hashes, text_bytes
from recordmill.session import scratch_path
from recordmill.sources.blocks import locate

#: Keys of a shard: about 5 MB of arrays.
SHARD_KEYS = 1 << 18
SHARDS_HELD = 12
#: Bytes of text whose lines probe the shards together.
RUN_BYTES = 8 << 20
#: Bits for each key of a level, and levels before the few keys left are listed.
_SPARE, _LEVELS = 2, 40

_U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Lines:
    """Lines of several texts: byte bounds, first line of each text, bounds of the stripped line."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def cut_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Every text has one line more than line breaks; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    # Ends of lines: each break, and each text's end behind the breaks inside it.
    ends = np.concatenate([breaks, offsets[1:]])
    of = np.concatenate([np.searchsorted(offsets[1:], breaks, "right"), np.arange(len(offsets) - 1)])
    order = np.lexsort((np.arange(len(ends)), of))
    end, of = ends[order], of[order]
    first = np.searchsorted(of, np.arange(len(offsets)))
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = offsets[:-1]
    solid = np.flatnonzero(~_BLANK[data])
    at, to = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = to > at
    if len(solid):
        key_start = np.where(some, solid[np.minimum(at, len(solid) - 1)], start)
        key_end = np.where(some, solid[np.maximum(to, 1) - 1] + 1, start)
    else:
        key_start, key_end = start, start
    return Lines(data, start, end, first, key_start, key_end)


def long_lines(lines: Lines, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, first hash, second hash) of the lines whose keys have ``min_chars`` code points."""
    letters = np.concatenate([[0], np.cumsum((lines.data & 0xC0) != 0x80)])
    which = np.flatnonzero(letters[lines.key_end] - letters[lines.key_start] >= min_chars)
    low = lower_ascii(lines.data)
    a, b = lines.key_start[which], lines.key_end[which]
    return which, span_hashes(low, a, b, 0), span_hashes(low, a, b, 1)


@dataclass
class PerfectHash:
    """Numbers 0 .. n - 1 for n distinct keys; another key gets any number or -1."""

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray
    left: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the positions in ``keys`` in the order of their numbers."""
        rest, sizes, words, numbered = np.arange(len(keys)), [], [], []
        for level in range(_LEVELS):
            if not len(rest):
                break
            size = -(-max(64, _SPARE * len(rest)) // 64) * 64
            spot = _spot(keys[rest], level, size)
            alone = np.bincount(spot, minlength=size) == 1
            taken = alone[spot]
            numbered.append(rest[taken][np.argsort(spot[taken])])
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~taken]
        left = rest[np.argsort(keys[rest], kind="stable")]
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        order = np.concatenate([*numbered, left]) if numbered else left
        return cls(sizes, bits, before, keys[left]), order.astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out, rest, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                return out
            spot = _spot(keys[rest], level, size)
            word = self.bits[base + (spot >> 6)]
            bit = (spot & 63).astype(_U64)
            here = (word >> bit) & _U64(1) == 1
            lower = word[here] & ((_U64(1) << bit[here]) - _U64(1))
            out[rest[here]] = self.before[base + (spot[here] >> 6)] + np.bitwise_count(lower)
            rest, base = rest[~here], base + size // 64
        if len(self.left):
            at = np.searchsorted(self.left, keys[rest])
            there = (at < len(self.left)) & (self.left[np.minimum(at, len(self.left) - 1)] == keys[rest])
            out[rest[there]] = self.before[-1] + at[there]
        return out


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + _U64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % _U64(size)).astype(np.int64)


@dataclass(frozen=True)
class LineIndex:
    """A written index: folder of its shards (null where no line repeats) and their number."""

    path: str | None
    shards: int
    min_chars: int
    min_docs: int


def _shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return ((first >> _U64(32)) * _U64(shards) >> _U64(32)).astype(np.int64)


def build_index(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> LineIndex:
    """Index of the lines of at least ``min_chars`` code points found in ``min_docs`` documents.

    Documents are told apart by their id: rows of one id are one document, rows without an
    id together are another, whose id counts as the smallest.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", RUN_BYTES // 2):
            lines = cut_lines(*text_bytes(table.column("text")))
            which, first, second = long_lines(lines, min_chars)
            owner = lines.owner[which]
            order = np.lexsort((second, first, owner))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(owner[order]) != 0) | (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
            pick = order[new]
            out = pa.table(
                {
                    "first": first[pick].view(np.int64),
                    "second": second[pick].view(np.int64),
                    "doc_id": table.column("doc_id").take(pa.array(owner[pick])),
                }
            )
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 15)

    seen = source.mapInArrow(hashes, f"first bigint, second bigint, doc_id {kind}").distinct()
    repeated = (
        seen.groupBy("first", "second")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    held = scratch_path(spark, "lines")
    repeated.write.parquet(held)
    repeated = spark.read.schema(repeated.schema).parquet(held)
    count = repeated.count()
    if not count:
        return LineIndex(None, 0, min_chars, min_docs)
    shards = -(-count // SHARD_KEYS)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False).view(_U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard_of(first, shards)), *batch.columns], ["shard", *batch.schema.names]
            )

    def build(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy().view(_U64)
        found, order = PerfectHash.build(first)
        sorted_by_number = table.take(pa.array(order)).combine_chunks()
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        column = lambda name: sorted_by_number.column(name).chunk(0)
        whole = lambda name: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), column(name))
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "sizes": one(found.sizes, pa.int64()),
                "bits": one(found.bits.view(np.int64), pa.int64()),
                "left": one(found.left.view(np.int64), pa.int64()),
                "fingerprint": whole("second"),
                "docs": whole("docs"),
                "keeper": whole("keeper"),
            }
        )

    dealt = repeated.mapInArrow(numbers, f"shard bigint, first bigint, second bigint, docs bigint, keeper {kind}")
    built = dealt.groupBy("shard").applyInArrow(
        build,
        "shard bigint, sizes array<bigint>, bits array<bigint>, left array<bigint>, fingerprint array<bigint>, "
        f"docs array<bigint>, keeper array<{kind}>",
    )
    path = scratch_path(spark, "line-index")
    built.write.partitionBy("shard").parquet(path)
    return LineIndex(path, shards, min_chars, min_docs)


@dataclass
class Shard:
    hash: PerfectHash
    fingerprint: np.ndarray
    docs: np.ndarray
    keeper: pa.Array

    def find(self, first: np.ndarray, second: np.ndarray, min_docs: int) -> np.ndarray:
        """Numbers of the indexed lines, -1 for others."""
        at = self.hash.number(first)
        if len(self.hash.left):  # equal first hashes stand next to each other at the end
            low = int(self.hash.before[-1])
            for k in np.flatnonzero(at >= low):
                same = np.flatnonzero((self.hash.left == first[k]) & (self.fingerprint[low:] == second[k]))
                at[k] = low + same[0] if len(same) else -1
        known = at >= 0
        known[known] = (self.fingerprint[at[known]] == second[known]) & (self.docs[at[known]] >= min_docs)
        return np.where(known, at, -1)


@functools.lru_cache(maxsize=SHARDS_HELD)
def load_shard(path: str, shard: int) -> Shard:
    system, folder = locate(f"{path}/shard={shard}")
    row = pds.dataset(folder, filesystem=system, format="parquet").to_table().combine_chunks()
    values = lambda name: row.column(name).chunk(0).flatten()
    unsigned = lambda name: values(name).to_numpy(zero_copy_only=False).view(_U64)
    bits = unsigned("bits")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    found = PerfectHash(values("sizes").to_pylist(), bits, before, unsigned("left"))
    return Shard(found, unsigned("fingerprint"), values("docs").to_numpy(), values("keeper"))


def annotate(
    docs: DataFrame, index: LineIndex, *, doc_id: str = "doc_id", text: str = "text", min_docs: int | None = None
) -> DataFrame:
    """``docs`` with __lines, __dropped (counts) and __kept (the text without the dropped lines).

    A line indexed with at least ``min_docs`` documents (the index's own bound, or more) is
    dropped everywhere but in the document with the largest id that holds it, where every
    occurrence stays.  A null or empty text is one empty line.  Rows of that largest id all
    keep the line, so repeated rows are treated alike.  A text may be of any length.
    Input columns with the three added names are replaced; other columns stay as they are.
    """
    bound = index.min_docs if min_docs is None else min_docs
    if bound < index.min_docs:
        raise ValueError("the index holds only lines of more documents")
    added = {"__lines": "long", "__dropped": "long", "__kept": "string"}
    docs = docs.drop(*added)

    def work(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table.column(text))
        lines = cut_lines(data, offsets)
        drop = np.zeros(len(lines.start), bool)
        if index.path:
            which, first, second = long_lines(lines, index.min_chars)
            owner, shard = lines.owner[which], _shard_of(first, index.shards)
            ids = table.column(doc_id).combine_chunks()
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                held = load_shard(index.path, int(shard[part[0]]))
                at = held.find(first[part], second[part], bound)
                part, at = part[at >= 0], at[at >= 0]
                mine, kept = ids.take(pa.array(owner[part])), held.keeper.take(pa.array(at))
                same = pc.equal(mine, kept.cast(mine.type))
                both_null = pc.and_(mine.is_null(), kept.is_null())
                stays = pc.or_(same.fill_null(False), both_null).to_numpy(zero_copy_only=False)
                drop[which[part[~stays]]] = True
        kept = _without(lines, offsets, drop)
        count = lambda flags: np.add.reduceat(flags.astype(np.int64), lines.first[:-1])
        return (
            table.append_column("__lines", pa.array(np.diff(lines.first)))
            .append_column("__dropped", pa.array(count(drop)))
            .append_column("__kept", kept)
        )

    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return map_tables(docs, work, schema, text, RUN_BYTES)


def _without(lines: Lines, offsets: np.ndarray, drop: np.ndarray) -> pa.Array:
    """The texts without the dropped lines, the others joined by line breaks."""
    stays = np.flatnonzero(~drop)
    owner = lines.owner[stays]
    # A line that stays before another one of its text keeps the break behind it.
    followed = np.zeros(len(stays), bool)
    followed[:-1] = owner[1:] == owner[:-1]
    places = len(lines.data) + 1
    opened, closed = (np.bincount(x[stays], minlength=places) for x in (lines.start, lines.end))
    keep = np.cumsum(opened - closed) > 0
    keep[lines.end[stays[followed]]] = True
    out = np.ascontiguousarray(lines.data[keep[:-1]])
    length = lines.end[stays] - lines.start[stays] + followed
    size = np.bincount(owner, length, len(offsets) - 1).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with repeated lines dropped from their texts; null texts stay null."""
    index = build_index(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    found = annotate(docs, index, doc_id=doc_id, text=text)
    shown = F.when(F.col(text).isNotNull(), F.col("__kept")).alias(text)
    return found.select(*[shown if c == text else F.col(f"`{c}`") for c in docs.columns])
