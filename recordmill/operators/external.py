"""Running a program or a function over records beside replicated files."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.functions.options import split_words
from recordmill.sources.blocks import BATCH_BYTES

RESULT = "output BINARY, exit_code INT, error STRING"


def _command(program: str | list[str]) -> list[str]:
    return split_words(program) if isinstance(program, str) else list(program)


def run_per_record(
    records: DataFrame, order: str, payload: str, program: str | list[str], shared: Sequence[str] = ()
) -> DataFrame:
    """(order, output, exit_code, error): the record on stdin, its bytes from stdout.

    ``shared`` files are copied once to every node; the program runs in their
    folder and opens them by name.  A program that fails or is killed marks its
    own record; the job goes on.
    """
    for path in shared:
        records.sparkSession.sparkContext.addFile(path)
    command, columns = _command(program), ["at", "output", "exit_code", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = SparkFiles.getRootDirectory() if shared else None
        for batch in batches:
            out, held = [], 0
            for at, data in zip(batch["at"], batch["payload"]):
                done = subprocess.run(command, input=bytes(data), capture_output=True, cwd=folder)
                failed = done.stderr.decode(errors="replace") if done.returncode else None
                out.append((at, done.stdout, done.returncode, failed))
                held += len(done.stdout)
                if held > BATCH_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    staged = records.select(F.col(order).alias("at"), F.col(payload).cast("binary").alias("payload"))
    return staged.mapInPandas(run, f"at BIGINT, {RESULT}").withColumnRenamed("at", order)


def run_per_batch(records: DataFrame, payload: str, program: str | list[str]) -> DataFrame:
    """(records, output): one process per Arrow batch, records written back to back.

    For programs that read many records per run: the start-up cost is shared,
    and a batch bounds what one process holds.
    """
    command = _command(program)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = subprocess.run(command, input=b"".join(map(bytes, batch["payload"])), capture_output=True, check=True)
            yield pd.DataFrame([(len(batch), done.stdout)])

    staged = records.select(F.col(payload).cast("binary").alias("payload"))
    return staged.mapInPandas(run, "records INT, output BINARY")


def call_per_record(
    records: DataFrame, order: str, payload: str, function: Callable[[bytes], Iterable[tuple]], schema: str
) -> DataFrame:
    """(order, schema…, error): the rows a Python function gives for each record.

    An exception becomes one row with the ``error`` text and no values.
    """
    given = records.sparkSession.createDataFrame([], schema).columns
    names, width = ["at", *given, "error"], len(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for at, data in zip(batch["at"], batch["payload"]):
                try:
                    out += [(at, *row, None) for row in function(bytes(data))]
                except Exception as error:
                    out.append((at, *[None] * width, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, dtype=object, columns=names)

    staged = records.select(F.col(order).alias("at"), F.col(payload).cast("binary").alias("payload"))
    called = staged.mapInPandas(run, f"at BIGINT, {schema}, error STRING")
    return called.withColumnRenamed("at", order)
