"""Words of whole Arrow text columns as numpy arrays.

Texts are handled as UTF-8 bytes.  All separators used here are ASCII, and no byte
of a longer UTF-8 sequence is ASCII, so cutting bytes equals cutting characters.
Work buffers are bounded: texts are hashed in windows of ``WINDOW`` bytes, however
long a document is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WINDOW = 1 << 20
#: Rows of an Arrow batch: whole texts travel in them, so batches are kept short.
BATCH_ROWS = 512

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_tables(
    df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, text: str | None = None, limit: int = WINDOW
) -> DataFrame:
    """Apply ``work`` to runs of rows holding about ``limit`` bytes of ``text`` each."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, text, limit):
            yield from work(table).to_batches(max_chunksize=4096)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], text: str | None, limit: int) -> Iterator[pa.Table]:
    """Tables of consecutive batches with about ``limit`` bytes of ``text``."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += (batch.column(text) if text else batch).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text has no bytes."""
    flat = column.cast(pa.large_string()).fill_null("").combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.large_string())
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = flat.buffers()
    offsets = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: byte bounds, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes in the class ``inside``; a run ends with its text."""
    member = inside[data]
    starts, ends = member.copy(), member.copy()
    starts[1:] &= ~member[:-1]
    ends[:-1] &= ~member[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    starts[head], ends[tail] = member[head], member[tail]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (splitmix64)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(base)
    if held is None or len(held[0]) < size + 1:
        size = max(size, WINDOW) + 1
        forth, back = np.full(size, base, _U64), np.full(size, pow(base, -1, 1 << 64), _U64)
        forth[0] = back[0] = 1
        held = _powers[base] = (np.cumprod(forth), np.cumprod(back))
    return held


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, from prefix sums."""
    values = np.random.default_rng(1000 + seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
    base = (_BASE + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64) | 1
    out, i, n = np.empty(len(start), _U64), 0, len(start)
    while i < n:
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + WINDOW, "right")))
        high = int(end[j - 1])
        forth, back = _power_tables(base, high - low)
        sums = np.empty(high - low + 1, _U64)
        sums[0] = 0
        np.cumsum(values[data[low:high]] * forth[: high - low], out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * back[a] + (b - a).astype(_U64) * _U64(_BASE)
        i = j
    return mixed(out)


def shingle_hashes(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of each text the hashes of its runs of ``size`` words.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = words.counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(words.first[:-1], made)
    length = np.repeat(np.minimum(counts, size), made)
    out = mixed(hashes[at] + _U64(1))
    for k in range(1, size):
        longer = length > k
        step = mixed(out * _U64(_BASE) + hashes[np.minimum(at + k, max(len(hashes) - 1, 0))])
        out = np.where(longer, step, out)
    return out, first
