"""Where each output chunk came from, and putting the outputs back in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.plans.ordered import Running, running
from recordmill.sources.blocks import BATCH_BYTES, open_input

PART_BYTES = 1 << 26


def chunk_offsets(chunks: DataFrame, order: str, size: str, stream: Sequence[str], file: Sequence[str]) -> DataFrame:
    """Add ``voffset`` (within the stream) and ``poffset`` (within the file)."""
    within_stream = running(chunks, order, [Running("voffset", F.col(size), exclusive=True)], within=stream)
    return running(within_stream, order, [Running("poffset", F.col(size), exclusive=True)], within=file)


def order_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("file", "stream", "voffset")


def gather(index: DataFrame, data_suffix: tuple[str, str] = (".idx", ".out")) -> DataFrame:
    """(file, stream, voffset, payload): the indexed byte ranges of each data file.

    ``data_suffix`` turns an index file name into its data file name.  Ranges
    are fetched in (file, poffset) order so that reads of one file are sequential.
    """
    old, new = data_suffix
    columns = ["file", "stream", "voffset", "payload"]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("file", sort=False):
                with open_input(file.removesuffix(old) + new) as handle:
                    out, held = [], 0
                    for row in rows.itertuples(index=False):
                        handle.seek(row.poffset)
                        data = handle.read(row.size)
                        if len(data) < row.size:
                            raise ValueError(f"{file}: data file ends inside a chunk")
                        out.append((file, row.stream, row.voffset, data))
                        held += row.size
                        if held > BATCH_BYTES:
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
                    yield pd.DataFrame(out, columns=columns)

    spread = index.repartitionByRange("file", "poffset").sortWithinPartitions("file", "poffset")
    return spread.mapInPandas(fetch, "file STRING, stream INT, voffset BIGINT, payload BINARY")


def reassemble(
    chunks: DataFrame, stream: Sequence[str], order: str, payload: str, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(stream…, part, text): payloads joined in order, in parts of bounded size.

    A stream that fits one part comes back as one row.  A longer one is cut at
    chunk boundaries, so no row or group grows with a hot stream.
    """
    size = F.octet_length(payload).cast("long")
    stream = list(stream)
    placed = running(
        chunks.select(*stream, order, size.alias("size")),
        order,
        [Running("off", F.col("size"), exclusive=True)],
        within=stream,
    )
    parts = placed.select(*stream, order, F.expr(f"off div {part_bytes}").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct(order, payload)))
    return (
        chunks.join(parts, [*stream, order])
        .groupBy(*stream, "part")
        .agg(F.array_join(F.transform(ordered, lambda c: c[payload]), "").alias("text"))
    )
