"""Sinks: FASTA text, tab-separated hits, numbered parts, spread folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from recordmill.sources.blocks import BATCH_BYTES, locate

# Spark's folder of a null, and the key under which its Parquet files name their types.
NO_WORKER = "__HIVE_DEFAULT_PARTITION__"
SPARK_TYPES = "org.apache.spark.sql.parquet.row.metadata"


def save_mode(force: bool = False, append: bool = False) -> str:
    """Exclusive creation unless forced; ``force`` replaces, it never overlays."""
    if force and append:
        raise ValueError("choose force or append")
    return "overwrite" if force else "append" if append else "errorifexists"


def fasta_text(header: Column | str, sequence: Column | str) -> Column:
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    return F.concat(F.lit(">"), col(header), F.lit("\n"), col(sequence))


def write_fasta(df: DataFrame, path: str, *, header: str = "header", sequence: str = "sequence", force=False) -> None:
    df.select(fasta_text(header, sequence).alias("value")).write.mode(save_mode(force)).text(path)


def write_records(df: DataFrame, path: str, *, raw: str = "raw", force=False) -> None:
    """Write whole records, each closed by one newline."""
    df.select(F.regexp_replace(raw, r"\n$", "").alias("value")).write.mode(save_mode(force)).text(path)


def write_ordered(df: DataFrame, path: str, order: list[str], *, raw: str = "raw", force=False) -> None:
    """Part files whose concatenation in name order follows ``order``."""
    ordered = df.orderBy(*order)
    write_records(ordered, path, raw=raw, force=force)


def write_tab(df: DataFrame, path: str, *, force=False) -> None:
    df.write.mode(save_mode(force)).option("sep", "\t").option("emptyValue", "").csv(path)


def write_parts(df: DataFrame, path: str, part: str = "part", *, raw: str = "raw", order: str = "pos", force=False) -> None:
    """One folder per part number; a big part is written by several tasks.

    Rows of a part are range-split by ``order``, so no task holds a whole part.
    """
    spread = df.repartitionByRange(part, order).sortWithinPartitions(part, order)
    lines = spread.select(F.regexp_replace(raw, r"\n$", "").alias("value"), part)
    lines.write.mode(save_mode(force)).partitionBy(part).text(path)


class _Staged(WriterCommitMessage):
    def __init__(self, folder: str):
        self.folder = folder


class _SpreadWriter(DataSourceArrowWriter):
    """Rows sorted by their first column, a worker number: one Parquet file per worker and task.

    Tasks write below a hidden folder of this job; the commit renames whole HH
    folders, and goes below one only where the ranges of two tasks meet.
    """

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.uri = options["path"]
        system, folder = locate(self.uri)
        self.replaced = [info.path for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        if self.replaced and not overwrite:
            raise ValueError(f"{self.uri} already exists; use force")
        self.stage = f"{folder}/_temporary-{uuid.uuid4().hex}"
        self.types = StructType(schema.fields[1:]).json()

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, _ = locate(self.uri)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        attempt = f"{self.stage}/{context.taskAttemptId()}"
        system.create_dir(attempt)
        current, out, held, size = None, None, [], 0

        def flush() -> None:
            nonlocal size
            if held:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
                held.clear()
                size = 0

        def close() -> None:
            if out is not None:
                flush()
                out.close()

        try:
            for worker, rows in _runs(batches):
                if out is None or worker != current:
                    close()
                    current, folder = worker, f"{attempt}/{spread_folder(worker)}"
                    system.create_dir(folder)
                    out = pq.ParquetWriter(f"{folder}/{name}", rows.schema, filesystem=system, store_schema=False)
                    out.add_key_value_metadata({SPARK_TYPES: self.types})
                held.append(rows)
                size += rows.nbytes
                if size >= BATCH_BYTES:
                    flush()
        finally:
            close()
        return _Staged(attempt)

    def commit(self, messages) -> None:
        system, folder = locate(self.uri)
        system.create_dir(folder)
        for info in system.get_file_info(self.replaced):
            system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        for message in filter(None, messages):
            _move_into(system, message.folder, folder)
        self.abort(messages)
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages) -> None:
        system, _ = locate(self.uri)
        if system.get_file_info(self.stage).type != fs.FileType.NotFound:
            system.delete_dir(self.stage)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """(worker, its rows in a batch) of batches sorted by worker, nulls together."""
    for batch in batches:
        workers, rows = batch.column(0), batch.select(list(range(1, batch.num_columns)))
        none, values = workers.is_null().to_numpy(False), workers.fill_null(0).to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]) | (none[1:] != none[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end > start:
                yield None if none[start] else int(values[start]), rows.slice(start, end - start)


def spread_folder(worker: int | None) -> str:
    """HH/LL of a worker number: number div 100, number mod 100, both with its sign."""
    if worker is None:
        return f"hh={NO_WORKER}/ll={NO_WORKER}"
    hh, ll = divmod(abs(worker), 100)
    return f"hh={-hh if worker < 0 else hh:02d}/ll={-ll if worker < 0 else ll:02d}"


def _move_into(system: fs.FileSystem, source: str, target: str) -> None:
    """Rename what ``source`` holds to below ``target``, folder by folder where both have one."""
    there = {info.base_name for info in system.get_file_info(fs.FileSelector(target))}
    for info in system.get_file_info(fs.FileSelector(source)):
        if info.base_name in there:
            _move_into(system, info.path, f"{target}/{info.base_name}")
        else:
            system.move(info.path, f"{target}/{info.base_name}")


class SpreadDataSource(DataSource):
    """Sink ``recordmill_spread``: rows behind a worker number, in a folder HH/LL per worker."""

    @classmethod
    def name(cls) -> str:
        return "recordmill_spread"

    def schema(self) -> str:
        return "worker BIGINT"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _SpreadWriter(self.options, schema, overwrite)


def _local(spark: SparkSession, path: str) -> bool:
    """Whether Spark takes ``path`` for one of Hadoop's local file system."""
    if "://" not in path and not path.startswith("file:"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path.startswith("file:")


def write_spread(df: DataFrame, path: str, worker: str, *, force=False) -> None:
    """Folders HH/LL from a worker number: number div 100, number mod 100.

    A task writes a range of workers; rows of a large worker are split by their
    hash, so no task holds all of them.  Hadoop's local file system starts a
    ``chmod`` process for every folder, file and checksum file; there the tasks
    write the files themselves.
    """
    kept = [c for c in df.columns if c.lower() not in ("hh", "ll")]
    if not kept:
        raise ValueError("no column besides hh and ll")
    rows = df.select(F.col(f"`{worker}`").cast("long").alias("__worker"), *(F.col(f"`{c}`") for c in kept))
    # A rebalance would split partitions over its advisory size into tasks that all have files in all their folders.
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    dealt = rows.repartitionByRange("__worker", F.xxhash64(*hashed))
    if _local(df.sparkSession, path):
        df.sparkSession.dataSource.register(SpreadDataSource)
        dealt = dealt.sortWithinPartitions("__worker")
        dealt.write.format("recordmill_spread").mode("overwrite" if force else "append").save(path)
        return

    def two_digits(n: Column) -> Column:
        return F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), "0")

    named = dealt.withColumn("hh", two_digits(F.expr("__worker div 100"))).withColumn("ll", two_digits(F.expr("__worker % 100")))
    named.drop("__worker").write.mode(save_mode(force)).partitionBy("hh", "ll").parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """The rows below ``path``, each with its ``file``.

    Spark's own partition discovery takes time with the square of the number
    of folders, in the driver; it is for readers that want few of them.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def folder_numbers(file: Column) -> tuple[Column, Column]:
    """hh and ll of a file in its folder HH/LL; to be taken once per file rather than per row."""
    names = [F.regexp_extract(file, r"/hh=([^/]*)/ll=([^/]*)/[^/]*$", i) for i in (1, 2)]
    hh, ll = (F.nullif(name, F.lit(NO_WORKER)).cast("int") for name in names)
    return hh.alias("hh"), ll.alias("ll")
