"""Files of zlib blocks, and the binary lists and chunk indexes that go with them.

The formats are fixed: a v1 block is an 8-byte little-endian length and a zlib
stream; a v2 block is a 4-byte block size, a 2-byte count, ``count`` 8-byte
headers, an 8-byte length and a zlib stream; an index entry is 30 bytes.

Block payloads have no sync marker, so a file can only be walked from its
start.  The walk reads lengths and seeks over payloads; the payload ranges are
then shuffled and inflated in parallel, however large one file is.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from recordmill.plans.ordered import Running, dense_positions, running
from recordmill.session import materialize
from recordmill.sources.delimited import Paths

# Binary layouts.
LENGTH = "<q"
V2_HEAD = "<IH"
V2_ENTRY_BYTES = 8
INDEX_ENTRY = "<HQQQ4s"
INDEX_BYTES = 30
BATCH_BYTES = 1 << 23
INDEX_MARK = b"CRC!"

BLOCK_SCHEMA = "file STRING, block_id BIGINT, at BIGINT, stored_size BIGINT"


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark prints it (``file:/a`` included)."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def list_files(spark: SparkSession, paths: Paths, *, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, size) of every matching file, without reading contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))


def read_block_index(files: DataFrame, version: int = 1, *, skip_bad: bool = False) -> DataFrame:
    """(file, block_id, at, stored_size) for every block; payload bytes are skipped.

    A damaged header fails the job.  With ``skip_bad`` it ends its file, as nothing says where
    the next block starts: a last row without size carries what is wrong in an ``error`` column.
    """
    columns = ["file", "block_id", "at", "stored_size", "error"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"stored_size": "Int64"})[columns[: 5 if skip_bad else 4]]
        for batch in batches:
            for file, size in zip(batch["file"], batch["size"]):
                rows, block_id, at = [], 0, 0
                try:
                    with open_input(file) as handle:
                        for at, stored in _walk_blocks(handle, size, version):
                            rows.append((file, block_id, at, stored, None))
                            block_id += 1
                            if len(rows) == 10_000:
                                yield frame(rows)
                                rows = []
                except (OSError, ValueError) as bad:
                    if not skip_bad:
                        raise ValueError(f"{file}: block {block_id}: {bad}") from bad
                    rows.append((file, block_id, at, None, str(bad)))
                if rows:
                    yield frame(rows)

    return files.repartition("file").mapInPandas(walk, BLOCK_SCHEMA + ", error STRING" if skip_bad else BLOCK_SCHEMA)


def _walk_blocks(handle, size: int, version: int) -> Iterator[tuple[int, int]]:
    """(at, stored size) of the payload of every block of an open file."""
    head_bytes, length_bytes = struct.calcsize(LENGTH if version == 1 else V2_HEAD), struct.calcsize(LENGTH)
    while head := handle.read(head_bytes):
        if version == 2 and len(head) == head_bytes:
            _, count = struct.unpack(V2_HEAD, head)
            handle.seek(count * V2_ENTRY_BYTES, os.SEEK_CUR)
            head = handle.read(length_bytes)
        if len(head) < length_bytes:
            raise ValueError("truncated block header")
        (stored,) = struct.unpack(LENGTH, head)
        at = handle.tell()
        if stored < 0 or at + stored > size:
            raise ValueError("truncated block")
        yield at, stored
        handle.seek(stored, os.SEEK_CUR)


def read_blocks(
    spark: SparkSession, paths: Paths, *, version: int = 1, skip_bad: bool = False, **kw
) -> DataFrame:
    """(file, block_id, stored_size, payload): every block inflated.

    A damaged block or header fails the job.  With ``skip_bad`` it stays as a row without
    payload, and an ``error`` column says what is wrong with it; behind a damaged header the
    rest of its file is unknown.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "block_id", "stored_size", "payload", "error"][: 5 if skip_bad else 4]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"stored_size": "Int64"})
        for batch in batches:
            if skip_bad:
                lost = batch[batch["error"].notna()]
                yield frame([(r.file, r.block_id, None, None, r.error) for r in lost.itertuples(index=False)])
                batch = batch[batch["error"].isna()]
            for file, rows in batch.groupby("file", sort=False):
                with open_input(file) as handle:
                    out, held = [], 0
                    for row in rows.itertuples(index=False):
                        handle.seek(int(row.at))
                        try:
                            payload, error = zlib.decompress(handle.read(int(row.stored_size))), None
                        except zlib.error as bad:
                            if not skip_bad:
                                raise
                            payload, error = None, str(bad)
                        out.append((file, row.block_id, row.stored_size, payload, error)[: len(columns)])
                        held += len(payload or b"")
                        if held > BATCH_BYTES:
                            yield frame(out)
                            out, held = [], 0
                    yield frame(out)

    index = read_block_index(list_files(spark, paths, **kw), version, skip_bad=skip_bad)
    # Spread the blocks of one large file over all tasks before inflating.
    spread = index.repartition("file", "block_id")
    schema = "file STRING, block_id BIGINT, stored_size BIGINT, payload BINARY"
    return spread.mapInPandas(load, schema + ", error STRING" if skip_bad else schema)


class _Parts(WriterCommitMessage):
    def __init__(self, staged: list[tuple[str, str]], rows: int):
        self.staged, self.rows = staged, rows


class _PartWriter(DataSourceWriter):
    """Tasks write hidden files; the commit renames them.

    A retried or speculative task therefore leaves nothing behind.
    """

    suffixes: tuple[str, ...] = ()

    def __init__(self, options, overwrite: bool):
        self.uri, self.options = options["path"], dict(options)
        system, folder = locate(self.uri)
        found = [info.path for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        if found and not overwrite:
            raise ValueError(f"{self.uri} is not empty; use force")
        self.replaced = found

    def emit(self, rows, *handles) -> int:
        raise NotImplementedError

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = locate(self.uri)
        system.create_dir(folder)
        staged = [
            (f"{folder}/.attempt-{context.taskAttemptId()}{s}", f"{folder}/part-{context.partitionId():05d}{s}")
            for s in self.suffixes
        ]
        handles = [system.open_output_stream(path) for path, _ in staged]
        try:
            count = self.emit(rows, *handles)
        finally:
            for handle in handles:
                handle.close()
        return _Parts(staged, count)

    def commit(self, messages) -> None:
        system, _ = locate(self.uri)
        for path in self.replaced:
            system.delete_file(path)
        for message in filter(None, messages):
            for staged, final in message.staged:
                system.move(staged, final) if message.rows else system.delete_file(staged)

    def abort(self, messages) -> None:
        system, _ = locate(self.uri)
        for message in filter(None, messages):
            for staged, _ in message.staged:
                system.delete_file(staged)


class _BlockWriter(_PartWriter):
    suffixes = (".blocks",)

    def emit(self, rows, out) -> int:
        version, level = int(self.options.get("version", 1)), int(self.options.get("level", 9))
        count = 0
        for count, row in enumerate(rows, start=1):
            data = zlib.compress(bytes(row[0]), level)
            if version == 2:
                # One record per block: its header holds offset 0 and its size.
                out.write(struct.pack(V2_HEAD, len(row[0]), 1) + struct.pack("<II", 0, len(row[0])))
            out.write(struct.pack(LENGTH, len(data)) + data)
        return count


class _ChunkWriter(_PartWriter):
    suffixes = (".out", ".idx")

    def emit(self, rows, out, index) -> int:
        count = at = 0
        for count, row in enumerate(rows, start=1):
            stream, voffset, payload = row
            out.write(bytes(payload))
            index.write(struct.pack(INDEX_ENTRY, stream, voffset, at, len(payload), INDEX_MARK))
            at += len(payload)
        return count


class _GatherWriter(_PartWriter):
    """Rows (part, file, payload, error), sorted by part: one file per part, and a manifest per task."""

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = locate(self.uri)
        system.create_dir(folder)
        attempt, staged, tally = f"{folder}/.attempt-{context.taskAttemptId()}", [], {}
        part = out = None
        try:
            for row in rows:
                seen = tally.setdefault((row["part"], row["file"]), [0, 0, 0, None])
                if row["payload"] is None:
                    seen[2] += 1
                    seen[3] = seen[3] or row["error"]
                    continue
                if out is None or row["part"] != part:
                    if out is not None:
                        out.close()
                    part = row["part"]
                    staged.append((f"{attempt}-{part}", f"{folder}/part-{part:05d}"))
                    out = system.open_output_stream(staged[-1][0])
                out.write(bytes(row["payload"]))
                seen[0] += 1
                seen[1] += len(row["payload"])
        finally:
            if out is not None:
                out.close()
        if tally:
            staged.append((f"{attempt}-manifest", f"{folder}/manifest-{context.partitionId():05d}.parquet"))
            lines = [(file, part, *seen) for (part, file), seen in tally.items()]
            table = pa.Table.from_pylist([dict(zip(_MANIFEST.names, line)) for line in lines], _MANIFEST)
            with system.open_output_stream(staged[-1][0]) as sink:
                pq.write_table(table, sink)
        return _Parts(staged, len(tally))


_MANIFEST = pa.schema(
    [("file", pa.string()), ("part", pa.int64()), ("blocks", pa.int64()), ("bytes", pa.int64()), ("failed", pa.int64()), ("error", pa.string())]
)


class GatherDataSource(DataSource):
    """Sink ``recordmill_gather``: payloads in numbered parts, and what failed in a manifest."""

    @classmethod
    def name(cls) -> str:
        return "recordmill_gather"

    def schema(self) -> str:
        return "part BIGINT, file STRING, payload BINARY, error STRING"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _GatherWriter(self.options, overwrite)


class BlockDataSource(DataSource):
    """Sink ``recordmill_blocks``: payload rows in, one file of blocks per task out."""

    @classmethod
    def name(cls) -> str:
        return "recordmill_blocks"

    def schema(self) -> str:
        return "payload BINARY"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BlockWriter(self.options, overwrite)


class ChunkDataSource(DataSource):
    """Sink ``recordmill_chunks``: a data file and its 30-byte index per task."""

    @classmethod
    def name(cls) -> str:
        return "recordmill_chunks"

    def schema(self) -> str:
        return "stream INT, voffset BIGINT, payload BINARY"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ChunkWriter(self.options, overwrite)


def write_blocks(df: DataFrame, path: str, *, payload: str = "payload", version: int = 1, level: int = 9, force=False):
    """Write one block per row; rows keep their partition's order."""
    df.sparkSession.dataSource.register(BlockDataSource)
    (
        df.select(F.col(payload).cast("binary").alias("payload"))
        .write.format("recordmill_blocks")
        .mode("overwrite" if force else "append")
        .options(version=version, level=level)
        .save(path)
    )


def gather_blocks(
    spark: SparkSession, paths: Paths, out: str, *, version: int = 1, part_bytes: int = 128 << 20, force: bool = False, **kw
) -> DataFrame:
    """Inflate all blocks into ``part-00000``, ``part-00001``, … and return the manifest.

    Read in the order of their numbers, the parts hold the payloads in the order of file and block;
    a part has ``part_bytes`` and what its last block has beyond them.  A damaged block is left out, and so is the rest of
    a file behind a damaged header; the manifest names both.  It is written in the same commit
    as the parts: files are renamed one by one when all tasks are done, so a driver lost in
    that moment leaves some of them hidden.
    """
    spark.dataSource.register(GatherDataSource)
    found = materialize(read_blocks(spark, paths, version=version, skip_bad=True, **kw), "inflated")
    narrow = found.select("file", "block_id", F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("n"))
    placed = running(
        dense_positions(narrow, ["file", "block_id"], "position"), "position", [Running("before", F.col("n"), exclusive=True)]
    )
    part = F.expr(f"coalesce(before, 0) div {int(part_bytes)}")
    rows = found.join(placed.select("file", "block_id", "position", part.alias("part")), ["file", "block_id"])
    dealt = rows.repartition("part").sortWithinPartitions("part", "position").select("part", "file", "payload", "error")
    dealt.write.format("recordmill_gather").mode("overwrite" if force else "append").save(out)
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_part, last_part, blocks, bytes, failed, error): one row per gathered file that is not empty."""
    pieces = spark.read.schema("file STRING, part BIGINT, blocks BIGINT, bytes BIGINT, failed BIGINT, error STRING")
    return pieces.option("pathGlobFilter", "manifest-*.parquet").parquet(path).groupBy("file").agg(
        F.min(F.when(F.col("blocks") > 0, F.col("part"))).alias("first_part"),
        F.max(F.when(F.col("blocks") > 0, F.col("part"))).alias("last_part"),
        F.sum("blocks").alias("blocks"),
        F.sum("bytes").alias("bytes"),
        F.sum("failed").alias("failed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"),
    )


def write_chunks(df: DataFrame, path: str, *, force: bool = False) -> None:
    """Write (stream, voffset, payload) rows as data files with chunk indexes."""
    df.sparkSession.dataSource.register(ChunkDataSource)
    rows = df.select(F.col("stream").cast("int"), F.col("voffset").cast("long"), F.col("payload").cast("binary"))
    rows.write.format("recordmill_chunks").mode("overwrite" if force else "append").save(path)


def compress_files(spark: SparkSession, paths: Paths, out: str, *, level: int = 9, force: bool = False) -> None:
    """One block per input file, in path order over the parts."""
    files = spark.read.format("binaryFile").load(paths).orderBy("path")
    write_blocks(files.select(F.col("content").alias("payload")), out, level=level, force=force)


def block_counts(index: DataFrame) -> DataFrame:
    """Blocks and stored bytes per file plus a grand total (``file`` NULL)."""
    return index.rollup("file").agg(F.count("*").alias("blocks"), F.sum("stored_size").alias("bytes"))


def read_chunk_index(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """(file, entry, stream, voffset, poffset, size, mark) from 30-byte index entries.

    A partial entry at the end of a file is ignored.  Entries have a fixed
    width, so every file is cut into ranges that are read independently.
    """
    per_range = 1 << 16
    files = list_files(spark, paths, **kw)
    entries = F.floor(F.col("size") / INDEX_BYTES)
    ranges = files.where(F.col("size") >= INDEX_BYTES).select(
        "file",
        entries.cast("long").alias("entries"),
        F.explode(F.sequence(F.lit(0).cast("long"), (entries - 1).cast("long"), F.lit(per_range).cast("long"))).alias(
            "first"
        ),
    )

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                count = min(per_range, row.entries - row.first)
                with open_input(row.file) as handle:
                    handle.seek(row.first * INDEX_BYTES)
                    data = handle.read(count * INDEX_BYTES)
                out = pd.DataFrame(struct.iter_unpack(INDEX_ENTRY, data), columns=["stream", "voffset", "poffset", "size", "mark"])
                out.insert(0, "file", row.file)
                out["mark"] = out["mark"].str.decode("latin-1")
                out.insert(1, "entry", np.arange(row.first, row.first + count))
                yield out

    schema = "file STRING, entry BIGINT, stream INT, voffset BIGINT, poffset BIGINT, size BIGINT, mark STRING"
    return ranges.repartition("file", "first").mapInPandas(load, schema)


def read_index_marks(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """Listing form of the chunk index, every field in the order of the entries."""
    return read_chunk_index(spark, paths, **kw).orderBy("file", "entry")


def ids_to_binary(ids: DataFrame, column: str) -> DataFrame:
    """(first_id, n, payload): sorted big-endian 4-byte ids, one row per sorted run.

    An id outside 0 to 2^32 - 1 fails the job.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["id"].to_numpy()
            if len(values):
                if values[0] < 0 or values[-1] >= 1 << 32:
                    raise ValueError("an id does not fit into four bytes")
                yield pd.DataFrame([(int(values[0]), len(values), values.astype(">u4").tobytes())])

    ordered = ids.select(F.col(column).cast("long").alias("id")).repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInPandas(pack, "first_id BIGINT, n INT, payload BINARY")


def binary_to_ids(runs: DataFrame) -> DataFrame:
    """Inverse of :func:`ids_to_binary`: one BIGINT ``id`` per row."""
    digits = F.regexp_extract_all(F.hex("payload"), F.lit("(.{8})"), F.lit(1))
    return runs.select(F.explode(digits).alias("h")).select(F.conv("h", 16, 10).cast("long").alias("id"))
