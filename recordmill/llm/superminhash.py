"""Near-duplicate groups by SuperMinHash signatures, banding, verification and linking.

SuperMinHash (Ertl, 2017) gives every element one random permutation of the ``m``
signature slots; the element's step ``j`` offers the value ``j + r`` to the slot the
permutation visits at ``j``.  Slots are therefore correlated (lower variance than
independent MinHash), and a document stops as soon as no later step can lower a slot.

1. Documents with the same shingle set form a class; only its smallest id goes on.
2. Bands of the signature put classes in buckets; each class is compared with the
   smallest id of each of its buckets, on whole shingle sets.
3. Links found so far give components.  A bucket that holds one component has nothing
   left to say.  In the others the likeliest pairs of different components are compared first,
   and a pair that has meanwhile been joined is left out; only links leave the task.
4. Components over all links give the groups.

A true link is lost only when no band agrees or the signatures look far less alike than
they are (see ``Banding``); links kept are always exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.textarrays import (
    byte_class,
    lower_ascii,
    map_tables,
    mixed,
    prepare,
    shingle_hashes,
    span_hashes,
    split_words,
    text_bytes,
)
from recordmill.operators.clustering import single_linkage
from recordmill.session import materialize

#: Everything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = byte_class(lambda b: b != 32 and not 9 <= b <= 13)

_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)
#: Elements handled together; each needs one byte per signature slot.
_ELEMENTS = 1 << 15
#: Shingles compared with one centre in one task.
_CENTRE_WORK = 1 << 22
#: Ids that are replicated, of eight bytes each.
_REPLICATED_IDS = 1 << 22
#: Members of a bucket, and their shingles, in one block.
_BLOCK = 1024
_BLOCK_WORK = 1 << 21


@dataclass(frozen=True)
class Banding:
    """``bands`` of ``rows`` slots.

    At the threshold 0.8 a pair misses all 40 bands of 6 with probability
    (1 - 0.8^6)^40 = 5e-6.  ``floor`` is the share of equal 4-bit slots below which a pair
    is not verified: 4.5 standard deviations under what 0.8 gives, of independent slots.
    """

    bands: int = 40
    rows: int = 6
    threshold: int = 80
    shingle: int = 4

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        share = self.threshold / 100 + (1 - self.threshold / 100) / 16
        return share - 4.5 * (share * (1 - share) / self.slots) ** 0.5


def signatures(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set ``elements[first[i]:first[i+1]]`` (distinct uint64 values)."""
    sets = len(first) - 1
    out = np.full((sets, slots), np.inf)
    i = 0
    while i < sets:
        j = max(i + 1, int(np.searchsorted(first, first[i] + _ELEMENTS, "right")) - 1)
        for a in range(int(first[i]), int(first[j]), _ELEMENTS):  # one huge set goes piece by piece
            b = min(a + _ELEMENTS, int(first[j]))
            owner = np.searchsorted(first, np.arange(a, b), "right") - 1 - i
            _offer(out[i:j], elements[a:b], owner)
        i = j
    return out


def _offer(held: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lower the slots in ``held`` (sets x slots) by the elements, step by step."""
    slots = held.shape[1]
    visit = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(elements), slots)).copy()
    seed = elements.copy()
    for step in range(slots):
        # A step offers at least its number: sets whose slots are all lower are done.
        open_ = held.max(axis=1) > step
        keep = open_[owner]
        if not keep.all():
            visit, seed, owner = visit[keep], seed[keep], owner[keep]
        if not len(owner):
            return
        seed = seed + _STEP
        draw = mixed(seed)
        value = step + (draw >> _U64(32)).astype(np.float64) / 4294967296.0
        pick = step + ((draw & _U64(0xFFFFFFFF)) * _U64(slots - step) >> _U64(32)).astype(np.int64)
        row = np.arange(len(owner))
        slot = visit[row, pick].copy()
        visit[row, pick] = visit[:, step]
        cell = owner * slots + slot
        flat = held.reshape(-1)
        np.minimum.at(flat, cell, value)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, counts = [], [0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        own = np.sort(hashes[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        counts.append(len(own))
    return (np.concatenate(parts) if parts else hashes[:0]), np.cumsum(counts)


def shingle_sets(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    words = split_words(lower_ascii(data), offsets, WORD)
    hashes = span_hashes(words.data, words.start, words.end)
    return _distinct(*shingle_hashes(words, hashes, size))


_SKETCH = "doc_id {id}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, slots binary"


def sketch(docs: DataFrame, doc_id: str, text: str, banding: Banding) -> DataFrame:
    """Of each document: size and fingerprints of its shingle set, band hashes, 4 bits of each slot."""

    def work(table: pa.Table) -> pa.Table:
        elements, first = shingle_sets(table.column("text"), banding.shingle)
        held = signatures(elements, first, banding.slots)
        bits = held.view(np.uint64)
        bits = mixed(np.where(np.isinf(held), _U64(0), bits))
        lanes = bits.reshape(len(held), banding.bands, banding.rows)
        bands = np.zeros(lanes.shape[:2], _U64)
        for k in range(banding.rows):
            bands = mixed(bands * _STEP + lanes[:, :, k])
        nibbles = (bits & _U64(15)).astype(np.uint8)
        packed = nibbles[:, 0::2] << 4 | nibbles[:, 1::2]
        sums = lambda x: np.diff(np.concatenate([[_U64(0)], np.cumsum(x, dtype=_U64)])[first]).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(held) + 1) * banding.bands, pa.int32()), pa.array(bands.reshape(-1).view(np.int64))
        )
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_shingles": pa.array(np.diff(first).astype(np.int64)),
                "set_a": pa.array(sums(mixed(elements))),
                "set_b": pa.array(sums(mixed(elements ^ _STEP))),
                "bands": lists,
                "slots": pa.array([row.tobytes() for row in packed], pa.binary()),
            }
        )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_tables(rows, work, _SKETCH.format(id=rows.schema["doc_id"].dataType.simpleString()), "text")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", banding: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    A shingle is ``banding.shingle`` consecutive words; a shorter text has its whole word
    sequence as one.  Null, empty and wordless texts have no set and are linked with
    nothing.  component_id is the smallest id reachable over links of at least
    ``banding.threshold`` per cent, kept says that it is the own id.  Rows that repeat an
    id are one document: they share its component.  Other columns are not read; an empty
    table gives no rows.
    """
    sketched = materialize(sketch(docs, doc_id, text, banding), "sketch")
    sets = ["set_a", "set_b", "n_shingles"]
    filled = sketched.where("n_shingles > 0")
    classes = filled.groupBy(*sets).agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = filled.join(
        classes.select(F.col("rep").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in sets]), "doc_id"
    ).where(" AND ".join(f"{c} = _{c}" for c in sets))
    members = members.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "slots")

    banded = members.select("rep", F.posexplode("bands").alias("band", "hash"))
    banded = banded.select("rep", "band", F.xxhash64("band", "hash").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"))
    shared = banded.join(centres.where("centre < last").select("bucket", "centre"), "bucket")
    shared = materialize(shared, "buckets")
    pairs = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(_verified(_plausible(pairs, members, banding), texts, banding), "links")

    labels = _components(links)
    wider = materialize(_across(shared, labels, members, texts, banding), "links")
    labels = _components(links.unionByName(wider))

    found = classes.join(labels.toDF("rep", "cluster"), "rep", "left")
    found = found.select(*sets, F.coalesce("cluster", "rep").alias("component_id"))
    placed = sketched.select("doc_id", *sets).join(found, sets, "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", banding: Banding) -> DataFrame:
    """One document of each near-duplicate group, with all its columns.

    Rows that repeat an id stay one row; rows without an id all stay.
    """
    kept = groups(docs, doc_id=doc_id, text=text, banding=banding).where("kept").select(F.col(doc_id)).distinct()
    unnamed = docs.where(F.col(doc_id).isNull())
    return docs.join(kept, doc_id, "left_semi").dropDuplicates([doc_id]).select(*docs.columns).unionByName(unnamed)


def _components(links: DataFrame) -> DataFrame:
    linked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return single_linkage(linked, links)


def _plausible(pairs: DataFrame, members: DataFrame, banding: Banding) -> DataFrame:
    """Pairs whose signatures and sizes leave the threshold possible."""
    ends = members.select("rep", "n_shingles", "slots")
    both = pairs.join(ends.toDF("a", "n_a", "slots_a"), "a").join(ends.toDF("b", "n_b", "slots_b"), "b")
    low = F.lit(banding.threshold)
    fitting = both.where((100 * F.col("n_a") >= low * F.col("n_b")) & (100 * F.col("n_b") >= low * F.col("n_a")))
    floor = banding.floor * banding.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_slots(batch.column(c)) for c in ("slots_a", "slots_b"))
            keep = _equal(a, b) >= floor
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return fitting.mapInArrow(run, f"a {kind}, b {kind}, n_a bigint, n_b bigint")


def _slots(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal 4-bit slots, row by row."""
    differ = a ^ b
    return np.count_nonzero(differ & 240 == 0, axis=-1) + np.count_nonzero(differ & 15 == 0, axis=-1)


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the ids, picked where they are read unless there are very many ids."""
    ids = materialize(ids.distinct(), "needed")
    few = ids.count() <= _REPLICATED_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold.

    The texts compared with one centre ``a`` are dealt over as many tasks as their
    shingles need; each task streams them past the centre's set.
    """
    pairs = materialize(pairs, "pairs")
    load = pairs.groupBy("a").agg((F.sum("n_b") / _CENTRE_WORK).cast("int").alias("extra"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("extra") + 1).alias("part"))
    centres = dealt.select("a", "part").distinct()
    texts = _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    text_of = lambda name: texts.toDF(name, "text")
    rows = centres.join(text_of("a"), "a").select("a", "part", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    rows = rows.unionByName(dealt.join(text_of("b"), "b").select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set = None, None
        for batch in batches:
            elements, first = shingle_sets(pa.chunked_array([batch.column("text")]), banding.shingle)
            keep = np.zeros(batch.num_rows, bool)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for k in range(batch.num_rows):
                own = elements[first[k] : first[k + 1]]
                if b[k] is None:
                    centre, centre_set = a[k], own.copy()
                elif centre == a[k] and len(own):
                    keep[k] = _alike(centre_set, own, banding.threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _across(shared: DataFrame, labels: DataFrame, members: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Links (a, b) between members of one bucket and different components.

    A pair is compared in the first band that it shares only.  Large buckets are cut into
    blocks, and every two blocks meet in one task.
    """
    named = shared.join(labels.toDF("rep", "label"), "rep", "left")
    named = named.select("bucket", "band", "rep", F.coalesce("label", "rep").alias("label"))
    named = named.join(members.select("rep", "n_shingles"), "rep")
    mixed_ = named.groupBy("bucket").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.greatest(F.count("*") / _BLOCK, F.sum("n_shingles") / _BLOCK_WORK).cast("int").alias("cuts"),
    )
    rows = named.join(mixed_.where("low < high").select("bucket", "cuts"), "bucket")
    rows = materialize(rows, "open")
    needed = rows.select("rep").distinct()
    whole = members.join(needed, "rep", "left_semi").select("rep", "slots", "bands")
    whole = whole.join(_only(texts, needed.toDF("doc_id")).toDF("rep", "text"), "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cuts") + 1).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts"))))
    tile = ["bucket", "low", "high"]
    rows = rows.select(
        "bucket",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own",
        "band",
        "rep",
        "label",
        "n_shingles",
    ).join(whole, "rep")
    rows = rows.repartition(*tile).sortWithinPartitions(*tile)
    prepare(texts.sparkSession)
    kind = shared.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, tile):
            a, b = _block_links(block, banding)
            yield pa.record_batch({"a": pa.array(a, block.schema.field("rep").type), "b": pa.array(b, block.schema.field("rep").type)})

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _block_links(block: pa.Table, banding: Banding) -> tuple[list, list]:
    """Links that join the components of a block, the likeliest pairs compared first."""
    slots, reps = _slots(block.column("slots").combine_chunks()), block.column("rep").to_pylist()
    names, label = np.unique(np.asarray(block.column("label").combine_chunks()), return_inverse=True)
    size, own = np.asarray(block.column("n_shingles")), np.asarray(block.column("own"))
    lists = block.column("bands").combine_chunks()
    bands = np.asarray(lists.flatten()).reshape(len(reps), -1)
    band = block.column("band")[0].as_py()
    one_block = block.column("low")[0].as_py() == block.column("high")[0].as_py()
    floor, low = banding.floor * banding.slots, banding.threshold
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(len(reps)):
        other = label[k + 1 :] != label[k]
        if not one_block:
            other &= own[k + 1 :] != own[k]
        other &= (100 * size[k + 1 :] >= low * size[k]) & (100 * size[k] >= low * size[k + 1 :])
        at = np.flatnonzero(other) + k + 1
        if len(at):
            equal = _equal(slots[at], slots[k])
            keep = (equal >= floor) & ((bands[at] == bands[k]).argmax(axis=1) == band)
            found.append((np.full(keep.sum(), k), at[keep], equal[keep]))
    parent = np.arange(len(names))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a_out, b_out = [], []
    if not any(len(a) for a, _, _ in found):
        return a_out, b_out
    elements, first = shingle_sets(block.column("text"), banding.shingle)
    a, b, equal = map(np.concatenate, zip(*found, strict=True))
    for k in np.argsort(-equal, kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = root(label[i]), root(label[j])
        if x != y:
            left, right = elements[first[i] : first[i + 1]], elements[first[j] : first[j + 1]]
            if _alike(left, right, low):
                parent[x] = y
                a_out.append(min(reps[i], reps[j]))
                b_out.append(max(reps[i], reps[j]))
    return a_out, b_out


def _alike(left: np.ndarray, right: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(left, right)
    common = int((left[np.minimum(at, len(left) - 1)] == right).sum())
    return 100 * common >= threshold * (len(left) + len(right) - common)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(values[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
