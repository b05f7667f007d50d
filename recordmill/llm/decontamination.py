"""Benchmark decontamination by suffix arrays of the training text.

Each run of documents becomes one shard with a suffix array over its words.  Every
suffix of every benchmark item is looked up by binary search, which gives its longest
verbatim match and all places that share its first ``window`` words.  Documents never
move: a shard lives in the task that reads it, and only benchmark blocks of bounded
size are replicated, one pass over the shards for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recordmill.llm.textarrays import (
    byte_class,
    lower_ascii,
    map_tables,
    span_hashes,
    split_words,
    text_bytes,
)

#: Bytes of text in a shard (a longer document is a shard of its own).
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text replicated at once.
BLOCK_BYTES = 16 << 20
WINDOW_WORDS = 10

#: After lower-casing: ASCII letters and digits, and everything beyond ASCII.
WORD = byte_class(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)


@dataclass
class Tests:
    """Suffixes of the items of a benchmark block, as places in one array of word hashes."""

    hashes: np.ndarray  # of all words of all items
    begin: np.ndarray  # first word of each suffix
    length: np.ndarray  # words of each suffix
    need: np.ndarray  # words that must match; longer than the suffix: none is enough
    item: np.ndarray  # index into ids
    ids: list[list[str]]  # items with the same words stand together


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """``docs`` with what each document shares with the benchmark.

    Added: __hit_words (words of the document), __hit_start and __hit_end (word ranges
    inside occurrences, merged), __hit_items (items with occurring windows), __hit_longest,
    __hit_longest_item and __hit_longest_at (the longest verbatim match, its item and its
    first word).  A null text, an empty one and one without words share nothing; null item
    ids count as ''.  Rows are judged one by one, so repeated rows are all marked; an
    empty benchmark marks nothing.
    """
    marked = docs.withColumns(
        {
            "__hit_start": F.array().cast("array<bigint>"),
            "__hit_end": F.array().cast("array<bigint>"),
            "__hit_items": F.array().cast("array<string>"),
            "__hit_words": F.lit(None).cast("bigint"),
            "__hit_longest": F.lit(0).cast("bigint"),
            "__hit_longest_item": F.lit(None).cast("string"),
            "__hit_longest_at": F.lit(None).cast("bigint"),
        }
    )
    schema = StructType([StructField(f.name, f.dataType) for f in marked.schema])
    for block in _blocks(benchmark.select(F.col(item_id).cast("string"), F.col(item_text))):
        held = docs.sparkSession.sparkContext.broadcast(_tests(block, window))
        marked = map_tables(marked, lambda t, held=held: _search(t, text, held.value), schema, text, SHARD_BYTES)
    return marked


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, as they came."""
    return annotate(docs, benchmark, **options).where(F.size("__hit_start") == 0).select(*docs.columns)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size, any_block = [], 0, False
    for item, text in benchmark.toLocalIterator():
        block.append((item or "", text or ""))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            yield block
            block, size, any_block = [], 0, True
    if block or not any_block:
        yield block


def _tests(block: list[tuple[str, str]], window: int) -> Tests:
    data, offsets = text_bytes(pa.chunked_array([[t for _, t in block]], pa.string()))
    words = split_words(lower_ascii(data), offsets, WORD)
    hashes = span_hashes(words.data, words.start, words.end)
    alike: dict[bytes, list[int]] = {}
    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b > a:
            alike.setdefault(hashes[a:b].tobytes(), []).append(k)
    ids = [sorted({block[k][0] for k in group}) for group in alike.values()]
    sequences = [np.frombuffer(key, np.uint64) for key in alike]
    size = np.array([len(s) for s in sequences], np.int64)
    item = np.repeat(np.arange(len(sequences)), size)
    begin = np.arange(size.sum())
    length = np.repeat(np.cumsum(size), size) - begin
    flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
    return Tests(flat, begin, length, np.repeat(np.minimum(size, window), size), item, ids)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` codes that follow; codes are small non-negative integers.

    Ranks of short runs are combined into ranks of runs two or three times as long; only
    positions that still tie are sorted again.
    """
    n = len(codes)
    rank, order, reach = codes.astype(np.int64), np.arange(n), 1
    fresh = np.zeros(n, bool)
    slots = order.copy()
    while len(slots):
        base = int(rank.max()) + 1
        fold = 3 if base < 1 << 21 else 2
        index = order[slots]
        key = rank[index]
        for k in range(1, fold):
            at = index + k * reach
            key = key * base + np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        by = np.argsort(key)
        order[slots], key = index[by], key[by]
        fresh[slots] = np.concatenate([[True], key[1:] != key[:-1]])
        reach *= fold
        if reach >= depth:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    return order


def _bisect(column, target, low, high, right: bool):
    """Vectorised binary search inside [low, high) of each target."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        value = column(mid)
        below = value <= target[open_] if right else value < target[open_]
        low[open_] = np.where(below, mid + 1, low[open_])
        high[open_] = np.where(below, high[open_], mid)


def _longest(codes, order, sought, begin, length, need):
    """Of each test suffix: longest match, and the suffix-array range of its first ``need`` words."""
    n, rows = len(codes), len(length)
    low, high = np.zeros(rows, np.int64), np.full(rows, n, np.int64)
    matched = np.zeros(rows, np.int64)
    window = np.zeros((2, rows), np.int64)
    alive = np.flatnonzero(length > 0)
    d = 0
    while True:
        alive = alive[length[alive] > d]
        if not len(alive):
            return matched, window
        target = sought[begin[alive] + d]

        def column(slot, d=d):
            at = order[slot] + d
            return np.where(at < n, codes[np.minimum(at, n - 1)], 0)

        left = _bisect(column, target, low[alive], high[alive], False)
        right = _bisect(column, target, left, high[alive], True)
        found = right > left
        alive, left, right = alive[found], left[found], right[found]
        low[alive], high[alive], matched[alive] = left, right, d + 1
        whole = alive[need[alive] == d + 1]
        window[0, whole], window[1, whole] = low[whole], high[whole]
        d += 1


def _search(table: pa.Table, text: str, tests: Tests) -> pa.Table:
    data, offsets = text_bytes(table.column(text))
    words = split_words(lower_ascii(data), offsets, WORD)
    docs, counts = table.num_rows, words.counts
    known, code = np.unique(span_hashes(words.data, words.start, words.end), return_inverse=True)
    # One separator, code 0, ends each document; it matches no test word.
    codes = np.zeros(len(words) + docs, np.int64)
    codes[np.arange(len(words)) + words.owner] = code + 1
    begin = words.first[:-1] + np.arange(docs)
    sought = np.searchsorted(known, tests.hashes)
    if len(known):
        present = known[np.minimum(sought, len(known) - 1)] == tests.hashes
    else:
        present = np.zeros(tests.hashes.shape, bool)
    sought = np.where(present, sought + 1, -1)
    order = suffix_array(codes, int(tests.length.max(initial=1)))
    matched, (low, high) = _longest(codes, order, sought, tests.begin, tests.length, tests.need)

    times = high - low
    suffix = np.repeat(np.arange(len(times)), times)
    at = order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
    width = tests.need[suffix]
    doc = np.searchsorted(begin, at, "right") - 1
    extent = width.copy()
    growing = np.flatnonzero(matched[suffix] > extent)
    while len(growing):
        here = at[growing] + extent[growing]
        same = (codes[here] == sought[tests.begin[suffix[growing]] + extent[growing]]) & (codes[here] > 0)
        growing = growing[same]
        extent[growing] += 1
        growing = growing[extent[growing] < matched[suffix[growing]]]

    edge = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + width, minlength=len(codes) + 1)
    edge = edge.astype(np.int64)
    for name, sign in (("__hit_start", 1), ("__hit_end", -1)):  # what earlier blocks have found
        old = table.column(name).combine_chunks()
        lengths = np.asarray(old.value_lengths().fill_null(0))
        np.add.at(edge, np.repeat(begin, lengths) + np.asarray(old.flatten()), sign)
    inside = np.cumsum(edge)[:-1] > 0
    up = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    down = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    span_doc = np.searchsorted(begin, up, "right") - 1

    items: list[list[str]] = table.column("__hit_items").to_pylist()
    pairs = np.unique(doc * max(len(tests.ids), 1) + tests.item[suffix])
    for pair in pairs:
        d, k = divmod(int(pair), max(len(tests.ids), 1))
        items[d] = items[d] + tests.ids[k]
    best = table.column("__hit_longest").to_pylist()
    best_item = table.column("__hit_longest_item").to_pylist()
    best_at = table.column("__hit_longest_at").to_pylist()
    for k in np.lexsort((at, -extent, doc)):
        d = int(doc[k])
        if extent[k] > best[d]:
            best[d] = int(extent[k])
            best_item[d] = tests.ids[tests.item[suffix[k]]][0]
            best_at[d] = int(at[k] - begin[d])

    cuts = np.searchsorted(span_doc, np.arange(docs + 1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))
    added = {
        "__hit_start": lists(up - begin[span_doc]),
        "__hit_end": lists(down - begin[span_doc]),
        "__hit_items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
        "__hit_words": pa.array(counts.astype(np.int64)),
        "__hit_longest": pa.array(best, pa.int64()),
        "__hit_longest_item": pa.array(best_item, pa.string()),
        "__hit_longest_at": pa.array(best_at, pa.int64()),
    }
    for name, column in added.items():
        table = table.set_column(table.column_names.index(name), name, column)
    return table
