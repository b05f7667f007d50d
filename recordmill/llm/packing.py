"""Packing of documents into fixed windows with lexically close neighbours.

Full windows of a document stand alone.  What is left of each document, its piece, is
indexed: pieces are brought together by their rarest token and dealt into shards of
bounded size, each with a BM25 inverted index over its pieces.  Document frequencies are
counted over all tokens of all documents; the vocabulary bounds that table.  In a shard the
longest unused piece is the seed of a window, and the index returns its unused neighbours,
best first, which fill the window greedily; the last of them is cut to fit.  What remains at
the end of a shard is cut into windows of a power of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.textarrays import WINDOW, byte_class, gathered, prepare, span_hashes, text_bytes
from recordmill.session import materialize

#: Pieces of a shard: one index in the memory of one task.
SHARD_PIECES = 1024
#: Distinct text units whose tokens a worker remembers.
_REMEMBERED = 500_000
K1, B = 1.2, 0.75
#: The special token of the vocabulary; its string in a text is that token.
SPECIAL = "<|endoftext|>"
_SPECIAL = SPECIAL.encode()

_WHITE = byte_class(lambda b: b == 32 or 9 <= b <= 13 or 28 <= b <= 31)
_ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
_MARK = byte_class(lambda b: 33 <= b <= 126) & ~_ALNUM


class Encoder:
    """Token ids of texts; text units seen before are looked up by their 64-bit hash and length.

    A unit starts where the tokenizer always starts a new pre-token (see ``_units``), so
    units can be encoded one by one.
    """

    def __init__(self, path: str, end: int) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.special = {SPECIAL: len(ranks)}
        self.plain = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )
        self.end = end
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of each text with ``end`` behind them."""
        data, offsets = text_bytes(column)
        start, end, first = _units(data, offsets)
        hashes = span_hashes(data, start, end, 1)
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > _REMEMBERED:
            self._forget()
        place = np.searchsorted(self.hashes, unique)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == unique[known]
        known[known] = self.sizes[place[known]] == (end - start)[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(data, unique[new], start[at[new]], end[at[new]])
            place = np.searchsorted(self.hashes, unique)
        begin, count = self.begin[place][which], self.count[place][which]
        bound = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(begin - bound[:-1], count) + np.arange(bound[-1])
        # Documents stand behind one another, each with one more id.
        docs = len(offsets) - 1
        doc_first = bound[first] + np.arange(docs + 1)
        shift = np.repeat(np.arange(docs), np.diff(bound[first]))
        out = np.full(doc_first[-1], self.end, np.uint32)
        out[np.arange(bound[-1]) + shift] = self.ids[source]
        return out, doc_first

    def _add(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        one = self.plain.encode_ordinary
        ids = [self.plain.encode(t, allowed_special="all") if SPECIAL in t else one(t) for t in texts]
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        begin = len(self.ids) + np.cumsum(count) - count
        keep = ~np.isin(self.hashes, hashes)  # a unit of another length under the same hash
        merged = np.concatenate([self.hashes[keep], hashes])
        order = np.argsort(merged)
        join = lambda old, fresh: np.concatenate([old[keep], fresh])[order]
        self.sizes, self.begin = join(self.sizes, end - start), join(self.begin, begin)
        self.count, self.hashes = join(self.count, count), merged[order]
        self.ids = np.concatenate([self.ids, flat])


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the units and the first unit of each text.

    Pre-tokens hold white space in front only, and letters or digits never stand before
    punctuation in one of them.  So a new one starts at ASCII white space behind anything
    else, and at ASCII punctuation behind an ASCII letter or digit or a Latin-1 letter.
    Special tokens stay whole.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        white, mark, letter = _WHITE[data], _MARK[data], _ALNUM[data]
        # The last byte of white space beyond ASCII stands behind one of these bytes.
        far = np.zeros(len(data), bool)
        far[1:] = (data[1:] >= 128) & np.isin(data[:-1], [0xC2, 0x9A, 0x80, 0x81])
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 128) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] = (white[1:] & ~white[:-1] & ~far[:-1]) | (mark[1:] & letter[:-1])
        raw = data.tobytes()
        at = raw.find(_SPECIAL)
        while at >= 0:
            cut[at + 1 : at + len(_SPECIAL)] = False
            at = raw.find(_SPECIAL, at + len(_SPECIAL))
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data)) if len(start) else start
    return start, end, np.searchsorted(start, offsets)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(tokenizer: str, end: int) -> Encoder:
    """The worker's encoder; the file lies beside the worker's own tokenizer package."""
    if (tokenizer, end) not in _encoders:
        _encoders[tokenizer, end] = Encoder(public_tokenizers.path(tokenizer), end)
    return _encoders[tokenizer, end]


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.tiktoken",
    end: int = 0,
    window: int = 1024,
) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or
    empty text has one id, ``end``.  Repeated rows are documents of their own.  An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = materialize(_cut(rows, kind, tokenizer, end, window), "tokens")
    pieces = cut.where("tail IS NOT NULL")
    full = cut.where("size(crcs) > 0").select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
    full = full.select(
        "doc_id",
        (F.col("k") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    weights = docs.sparkSession.sparkContext.broadcast(_token_weights(cut))
    return full.unionByName(_packed(pieces, kind, weights, window))


def _cut(rows: DataFrame, kind: str, tokenizer: str, end: int, window: int) -> DataFrame:
    """Checksums of full windows and the ids of what is left; one last row of a task counts tokens."""
    prepare(rows.sparkSession)
    schema = f"doc_id {kind}, doc_tokens bigint, crcs array<bigint>, tail binary, tokens array<bigint>, docs array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, end)
        seen, id_type = np.zeros(1, np.int64), pa.null()
        for table in gathered(batches, "text", 2 * WINDOW):
            id_type = table.schema.field("doc_id").type
            ids, first = coder.encode(table.column("text"))
            owner = np.repeat(np.arange(table.num_rows, dtype=np.int64), np.diff(first))
            pairs = np.sort(owner << 32 | ids)  # faster than np.unique
            distinct = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
            count = np.bincount(distinct & 0xFFFFFFFF, minlength=len(seen)).astype(np.int64)
            count[: len(seen)] += seen
            seen = count
            crcs, tails = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[a:b].astype("<u4")
                whole = (b - a) // window * window
                crcs.append([zlib.crc32(own[k : k + window].tobytes()) for k in range(0, whole, window)])
                tails.append(own[whole:].tobytes() if b - a > whole else None)
            yield from pa.table(
                {
                    "doc_id": table.column("doc_id"),
                    "doc_tokens": pa.array(np.diff(first)),
                    "crcs": pa.array(crcs, pa.list_(pa.int64())),
                    "tail": pa.array(tails, pa.binary()),
                    "tokens": pa.nulls(table.num_rows, pa.list_(pa.int64())),
                    "docs": pa.nulls(table.num_rows, pa.list_(pa.int64())),
                }
            ).to_batches(max_chunksize=1024)
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.record_batch(
                {
                    "doc_id": pa.nulls(1, id_type),
                    "doc_tokens": pa.nulls(1, pa.int64()),
                    "crcs": pa.nulls(1, pa.list_(pa.int64())),
                    "tail": pa.nulls(1, pa.binary()),
                    "tokens": pa.array([used], pa.list_(pa.int64())),
                    "docs": pa.array([seen[used]], pa.list_(pa.int64())),
                }
            )

    return rows.mapInArrow(run, schema)


def _token_weights(cut: DataFrame) -> tuple[np.ndarray, float]:
    """(inverse document frequency by token, mean piece length) over all documents."""
    counts = cut.where("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "docs")).alias("x"))
    counts = counts.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.docs").alias("docs")).toPandas()
    documents, mean = cut.where("doc_tokens IS NOT NULL").agg(F.count("*"), F.avg(F.octet_length("tail") / 4)).first()
    frequency = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1)
    frequency[counts["token"].to_numpy(np.int64)] = counts["docs"]
    return np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5)), float(mean or 1)


def rarity(idf: np.ndarray) -> np.ndarray:
    """Tokens, the rarest first; of equally rare ones the smallest."""
    return np.argsort(-idf, kind="stable")


def rarest(tails: pa.Array, order: np.ndarray) -> np.ndarray:
    """The token of each piece that is first in ``order``; no piece is empty."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parts = [np.frombuffer(tail.as_buffer(), "<u4") for tail in tails]
    first = np.cumsum([0, *map(len, parts[:-1])])
    return order[np.minimum.reduceat(rank[np.concatenate(parts)], first)]


def _packed(pieces: DataFrame, kind: str, weights, window: int) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rarity(weights.value[0])
        for batch in batches:
            if not batch.num_rows:
                continue
            key = rarest(batch.column("tail"), order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), *(batch.column(c) for c in ("doc_id", "doc_tokens", "tail"))],
                ["key", "doc_id", "doc_tokens", "tail"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = weights.value
        sequence = TaskContext.get().partitionId() << 40
        for table in _dealt(batches, SHARD_PIECES):
            ids = [np.frombuffer(x.as_buffer(), "<u4") for c in table.column("tail").chunks for x in c]
            placed = fill(ids, idf, mean, window)
            piece = np.array([p[0] for p in placed], np.int64)
            start, length = np.array([p[1] for p in placed], np.int64), np.array([p[2] for p in placed], np.int64)
            tokens = np.asarray(table.column("doc_tokens"))[piece]
            tail = np.array([len(x) for x in ids])[piece]
            crcs = [zlib.crc32(ids[k][a : a + n].tobytes()) for k, a, n, _, _ in placed]
            number = np.array([p[3] for p in placed], np.int64)
            yield from pa.table(
                {
                    "doc_id": table.column("doc_id").take(pa.array(piece)),
                    "start": pa.array(tokens - tail + start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": pa.array(tokens),
                    "sequence_id": pa.array((sequence + number) * 2 + 1),
                    "offset": pa.array([p[4] for p in placed], pa.int64()),
                }
            ).to_batches(max_chunksize=4096)
            sequence += int(number.max()) + 1

    near = pieces.select("doc_id", "doc_tokens", "tail").mapInArrow(
        keyed, f"key bigint, doc_id {kind}, doc_tokens bigint, tail binary"
    )
    # A range of (rarest token, document): a token that holds many documents is cut by document.
    near = near.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return near.mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def _dealt(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Index:
    """Inverted BM25 index over the pieces of a shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.size = len(ids)
        length = np.array([len(x) for x in ids])
        owner = np.repeat(np.arange(self.size, dtype=np.int64), length)
        pairs, times = np.unique(np.concatenate(ids).astype(np.int64) << 32 | owner, return_counts=True)
        token, self.piece = pairs >> 32, pairs & 0xFFFFFFFF
        norm = K1 * (1 - B + B * length[self.piece] / mean)
        self.weight = idf[token] * times * (K1 + 1) / (times + norm)
        self.tokens, first = np.unique(token, return_index=True)
        self.first = np.append(first, len(token))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every piece for the distinct tokens of ``query``."""
        at = np.searchsorted(self.tokens, np.unique(query))
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        where = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.piece[where], self.weight[where], self.size)


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of every part of every piece."""
    index = Index(ids, idf, mean)
    left = np.array([len(x) for x in ids])
    done = np.zeros(len(ids), np.int64)  # ids placed before
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def put(k: int, size: int, offset: int) -> None:
        out.append((k, int(done[k]), size, sequence, offset))
        done[k] += size
        left[k] -= size

    while left.sum() >= window:
        seed = int(left.argmax())
        score = index.scores(ids[seed][done[seed] :])
        used = int(left[seed])
        put(seed, used, 0)
        unused = np.flatnonzero(left)
        for k in unused[np.argsort(-score[unused], kind="stable")].tolist():
            size = min(int(left[k]), window - used)
            put(k, size, used)
            used += size
            if used == window:
                break
        sequence += 1
    rest = int(left.sum())
    queue = np.flatnonzero(left).tolist()
    while rest:
        size = 1 << (rest.bit_length() - 1)
        used = 0
        while used < size:
            k = queue[0]
            part = min(int(left[k]), size - used)
            put(k, part, used)
            used += part
            if not left[k]:
                queue.pop(0)
        sequence, rest = sequence + 1, rest - size
    return out
