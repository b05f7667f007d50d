"""A stored inverted index with fielded terms, and Boolean retrieval over its postings.

``write_index`` stores two tables below one folder:

* ``postings``: per field, term and run of ids one block of delta-coded ids, in partitions by a
  hash of field and term and sorted by them, so a term is read from few row groups of one
  partition.  A run covers ``SPAN`` ids, so no block grows with a frequent term.
* ``dictionary``: the number of records of every field and term.

``retrieve`` reads only the blocks of the terms asked for, brings the blocks of a run of ids
together, and evaluates AND, OR, BUTNOT and RANGE there on bitmaps.  No record is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one block at most.
SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
#: Places of terms that a task holds while it indexes.
HELD = 1 << 21
#: Records whose texts a task splits at a time.
TAKEN = 256

#: Bytes of UTF-8 with white space for all but lower-case letters.
_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))

_POSTINGS = "field STRING, term STRING, block BIGINT, n BIGINT, deltas ARRAY<INT>, bucket INT"
_DICTIONARY = "field STRING, term STRING, records BIGINT"


@dataclass(frozen=True)
class Term:
    """Records that hold a term in a field."""

    field: str
    term: str


@dataclass(frozen=True)
class Range:
    """Records whose number in a field lies between both bounds, inclusive."""

    field: str
    low: int
    high: int


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class ButNot:
    keep: object
    drop: object


@dataclass(frozen=True)
class Ids:
    """A given list of ids, such as the result of another query."""

    ids: tuple[int, ...]


Query = Term | Range | And | Or | ButNot | Ids


def number_term(value: Column | int) -> Column | str:
    """Whole numbers as terms whose order is that of the numbers."""
    shift = 10**18
    if isinstance(value, int):
        return f"{value + shift:019d}"
    return F.lpad((value.cast("decimal(20,0)") + F.lit(shift).cast("decimal(20,0)")).cast("string"), 19, "0")


def _bucket(field: str, term: str, buckets: int) -> int:
    return zlib.crc32(f"{field}\0{term}".encode()) % buckets


def write_index(
    records: DataFrame,
    id_column: str,
    path: str,
    *,
    words: Mapping[str, str] | None = None,
    keys: Mapping[str, str] | None = None,
    numbers: Mapping[str, str] | None = None,
    buckets: int = 32,
) -> None:
    """Index ``records`` below ``path``.

    ``words`` maps fields to text columns (lower-case runs of letters), ``keys`` to columns
    taken whole, ``numbers`` to whole numbers for ranges.  Ids are integers; a record without
    an id is not indexed, and rows of one id are one record.  Null values give no terms.
    """
    text = {name: F.lower(F.col(column)) for name, column in (words or {}).items()}
    whole = {name: F.col(column).cast("string") for name, column in (keys or {}).items()}
    whole |= {name: number_term(F.col(column)) for name, column in (numbers or {}).items()}
    fields = [(name, split) for part, split in ((text, True), (whole, False)) for name in part]
    columns = [column.alias(f"f{k}") for k, column in enumerate([*text.values(), *whole.values()])]
    rows = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), *columns)
    runs = rows.mapInArrow(lambda batches: _tallied(batches, fields), "field STRING, term STRING, block BIGINT, places ARRAY<INT>")
    bucket = F.crc32(F.concat_ws("\0", "field", "term").cast("binary")) % buckets
    dealt = runs.withColumn("bucket", bucket.cast("int")).withColumn("part", F.pmod(F.hash("term"), F.lit(8))).repartition("bucket", "part")
    # Bucket and part follow from the term, so the rows already lie where they are grouped and written.
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))
    blocks = dealt.groupBy("bucket", "part", "field", "term", "block").agg(places.alias("places"))
    deltas = F.transform("places", lambda x, i: x - F.when(i == 0, 0).otherwise(F.get("places", i - 1)))
    coded = blocks.select("field", "term", "block", F.size("places").cast("long").alias("n"), deltas.alias("deltas"), "bucket")
    coded.sortWithinPartitions("bucket", "field", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = records.sparkSession.read.schema(_POSTINGS).parquet(f"{path}/postings")
    counts = stored.groupBy("field", "term").agg(F.sum("n").alias("records"))
    counts.sortWithinPartitions("field", "term").write.parquet(f"{path}/dictionary")
    records.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/settings")


def _tallied(batches: Iterator[pa.RecordBatch], fields: Sequence[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    """(field, term, block, places): the places in a block of the records of a run that hold a term.

    ``fields`` has per column its field and whether its text is split into words.  A task holds
    the terms of ``HELD`` places at most, and those of one more batch of ``TAKEN`` records.
    """
    held: list[list[tuple[pa.Array, np.ndarray]]] = [[] for _ in fields]
    count = 0
    for batch in (big.slice(k, TAKEN) for big in batches for k in range(0, big.num_rows, TAKEN)):
        ids = np.asarray(batch.column(0))
        for (_, split), own, column in zip(fields, held, batch.columns[1:], strict=True):
            if split:
                found = [() if v is None else set(v.translate(_LETTERS).split()) for v in column.cast(pa.binary()).to_pylist()]
                terms = pa.array([t for words in found for t in words], pa.binary()).cast(pa.string())
                own.append((terms, np.repeat(ids, [len(words) for words in found])))
            else:
                own.append((column.drop_null(), ids[np.asarray(column.is_valid())]))
            count += len(own[-1][0])
        if count >= HELD:
            yield from _runs(fields, held)
            held, count = [[] for _ in fields], 0
    yield from _runs(fields, held)


def _runs(fields: Sequence[tuple[str, bool]], held: list[list[tuple[pa.Array, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for (field, _), own in zip(fields, held, strict=True):
        if not sum(len(terms) for terms, _ in own):
            continue
        terms = pa.chunked_array([terms for terms, _ in own]).combine_chunks().dictionary_encode()
        ids = np.concatenate([part for _, part in own])
        code, block = np.asarray(terms.indices), ids >> SPAN_BITS
        order = np.lexsort((block, code))
        code, block = code[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
        bounds = pa.array(np.append(first, len(code)), pa.int32())
        places = pa.ListArray.from_arrays(bounds, pa.array((ids[order] & SPAN - 1).astype(np.int32)))
        names = pa.array([field] * len(first), pa.string())
        found = [names, terms.dictionary.take(pa.array(code[first])), pa.array(block[first]), places]
        yield from pa.table(found, names=["field", "term", "block", "places"]).to_batches(max_chunksize=1 << 16)


@dataclass
class Index:
    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark, path, spark.read.parquet(f"{path}/settings").first()[0])

    def term_counts(self, field: str) -> DataFrame:
        """(term, records) of a field, from the dictionary."""
        return self.spark.read.schema(_DICTIONARY).parquet(f"{self.path}/dictionary").where(F.col("field") == field).select("term", "records")

    def postings(self, leaf: Term | Range) -> DataFrame:
        """The blocks of a term, or of all terms of a range; other partitions and terms are pruned."""
        stored = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("field") == leaf.field)
        if isinstance(leaf, Range):
            stored = stored.where(F.col("term").between(number_term(leaf.low), number_term(leaf.high)))
        else:
            stored = stored.where((F.col("term") == leaf.term) & (F.col("bucket") == _bucket(leaf.field, leaf.term, self.buckets)))
        return stored.select("block", "deltas")

    def retrieve(self, query: Query) -> DataFrame:
        """(id): the records that the query finds, each once."""
        leaves = list(dict.fromkeys(_leaves(query)))
        blocks = None
        for k, leaf in enumerate(leaves):
            if isinstance(leaf, Ids):
                given = self.spark.createDataFrame([(int(i),) for i in leaf.ids], "id long")
                block = F.floor(F.col("id") / SPAN)
                part = given.select(block.alias("block"), F.array((F.col("id") - block * SPAN).cast("int")).alias("deltas"))
            else:
                part = self.postings(leaf)
            part = part.withColumn("leaf", F.lit(k))
            blocks = part if blocks is None else blocks.unionByName(part)
        if blocks is None:
            return self.spark.createDataFrame([], "id long")
        number = {leaf: k for k, leaf in enumerate(leaves)}

        def evaluate(table: pa.Table) -> pa.Table:
            base = table.column("block")[0].as_py() * SPAN
            maps = np.zeros((len(leaves), SPAN), bool)
            for k, deltas in zip(table.column("leaf").to_pylist(), table.column("deltas"), strict=True):
                maps[k, np.cumsum(deltas.values.to_numpy(zero_copy_only=False))] = True
            return pa.table({"id": pa.array(base + np.flatnonzero(_evaluate(query, maps, number)), pa.int64())})

        return blocks.groupBy("block").applyInArrow(evaluate, "id long")


def _leaves(query: Query) -> list:
    if isinstance(query, And | Or):
        return [leaf for part in query.parts for leaf in _leaves(part)]
    if isinstance(query, ButNot):
        return [*_leaves(query.keep), *_leaves(query.drop)]
    return [query]


def _evaluate(query: Query, maps: np.ndarray, number: Mapping) -> np.ndarray:
    if isinstance(query, And):
        return np.logical_and.reduce([_evaluate(p, maps, number) for p in query.parts])
    if isinstance(query, Or):
        return np.logical_or.reduce([_evaluate(p, maps, number) for p in query.parts])
    if isinstance(query, ButNot):
        return _evaluate(query.keep, maps, number) & ~_evaluate(query.drop, maps, number)
    return maps[number[query]]


def all_of(*parts: Query) -> And:
    return And(tuple(parts))


def any_of(*parts: Query) -> Or:
    return Or(tuple(parts))


def terms(field: str, words: Sequence[str]) -> Or:
    return Or(tuple(Term(field, w) for w in words))
