"""Quality and toxicity of documents by co-training.

Two views judge a page: what its text says, and what is known about the page (source,
language, size, layout).  Each view has a log-odds classifier per target, fitted from counts.
In every round each view names the unlabelled documents that it is sure of, and the other
view learns from them as well.  At the end both views are calibrated on labelled documents
that taught neither, combined, and applied to all documents.

Only labelled rows are sampled (``LABELLED`` by hash).  All unlabelled documents are scored on the
executors in every round, which add up what they teach; the driver fits from the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from recordmill.llm.samples import smallest_hashes
from recordmill.llm.textarrays import (
    byte_class,
    gathered,
    lower_ascii,
    map_tables,
    span_hashes,
    split_words,
    text_bytes,
)
from recordmill.session import materialize

#: Labelled rows that classifiers are fitted on.
LABELLED = 8000
ROUNDS = 3
#: Share of right rows among those kept back from which on a view hands over what it names.
SURE = 0.95
TARGETS = ("quality", "toxic")
#: Log odds that a column needs, how sharply chance is told from more, and how soon evidence is enough.
LEAST_ODDS, SHARP, STEEP = 2.0, 8, 1.3

#: Columns of the text view: so many that a telling word seldom shares one.
_BUCKETS = 1 << 18
_META = 1 << 10
_WORD = byte_class(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)
_TOKEN = byte_class(lambda b: b > 32)
_PUNCTUATION = byte_class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)


@dataclass
class Rows:
    """Sparse rows of ones: columns of row k are ``columns[first[k]:first[k + 1]]``."""

    columns: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Rows:
        count = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[:-1][rows] - first[:-1], count) + np.arange(first[-1])
        return Rows(self.columns[at], first)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self)), np.diff(self.first))
        return np.bincount(owner, weights[self.columns], len(self))


def _rows(pairs: np.ndarray, width: int, count: int) -> Rows:
    """Rows from distinct owner * width + column numbers."""
    pairs = np.unique(pairs)
    return Rows(pairs % width, np.searchsorted(pairs, np.arange(count + 1) * width))


def _level(share: np.ndarray, cuts: list[float]) -> np.ndarray:
    return np.searchsorted(cuts, share, "right")


def text_view(column: pa.ChunkedArray) -> Rows:
    """Hashed words, and how the text is written: marks, capitals, repeated words."""
    data, offsets = text_bytes(column)
    count = len(offsets) - 1
    words = split_words(lower_ascii(data), offsets, _WORD)
    hashes = span_hashes(words.data, words.start, words.end)
    owner = words.owner
    pairs = [owner * _BUCKETS + (hashes % np.uint64(_BUCKETS - 64)).astype(np.int64)]
    size = np.maximum(np.diff(offsets), 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    marks = total(_PUNCTUATION[data]) / size
    capitals = total((data >= 65) & (data <= 90)) / size
    digits = total((data >= 48) & (data <= 57)) / size
    different = np.bincount(np.unique(owner << 40 | (hashes >> np.uint64(24)).astype(np.int64)) >> 40, minlength=count)
    repeats = 1 - different / np.maximum(words.counts, 1)
    shapes = [
        _level(marks, [0.01, 0.03, 0.06, 0.12, 0.2]),
        _level(capitals, [0.01, 0.05, 0.15, 0.4]),
        _level(digits, [0.001, 0.01, 0.05, 0.2]),
        _level(repeats, [0.05, 0.2, 0.4, 0.6, 0.8]),
        _level(words.counts, [1, 5, 20, 100, 1000]),
    ]
    for k, shape in enumerate(shapes):
        pairs.append(np.arange(count) * _BUCKETS + _BUCKETS - 64 + 8 * k + shape)
    return _rows(np.concatenate(pairs), _BUCKETS, count)


def page_view(table: pa.Table) -> Rows:
    """Source, language, size and layout of a page."""
    data, offsets = text_bytes(table.column("text"))
    count = len(offsets) - 1
    named = lambda c, seed: [hash_name(x, seed) for x in table.column(c).to_pylist()]
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
    tokens = split_words(data, offsets, _TOKEN).counts
    size = np.array([x or 0 for x in table.column("n_chars").to_pylist()], np.int64)
    line_length = np.diff(offsets) / lines
    word_length = np.diff(offsets) / np.maximum(tokens, 1)
    columns = [
        np.array(named("source", 1), np.int64).reshape(count),
        np.array(named("lang", 2), np.int64).reshape(count),
        800 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 31),
        840 + np.minimum(np.log2(lines).astype(np.int64), 31),
        880 + _level(line_length, [20, 60, 150, 400, 1000, 3000]),
        900 + _level(word_length, [3, 4, 5, 6, 7, 8, 10, 15]),
        920 + np.minimum(np.log2(np.maximum(tokens, 1)).astype(np.int64), 31),
    ]
    return _rows(np.concatenate([np.arange(count) * _META + c for c in columns]), _META, count)


def hash_name(value: str | None, seed: int) -> int:
    if value is None:
        return 700 + seed
    data = np.frombuffer(value.encode() or b"\0", np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), seed)[0] % np.uint64(700))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Counts:
    """Of one view and target: rows of each class, and how many of them have each column."""

    rows: np.ndarray
    columns: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Counts:
        return cls(np.zeros(2), np.zeros((2, width)))

    @classmethod
    def of(cls, rows: Rows, target: np.ndarray, width: int) -> Counts:
        """``target`` is 0 or 1, and anything else for rows that do not count."""
        out = cls.empty(width)
        for k in (0, 1):
            chosen = rows.take(np.flatnonzero(target == k))
            out.rows[k], out.columns[k] = len(chosen), np.bincount(chosen.columns, minlength=width)
        return out

    def joined(self, given: Counts) -> Counts:
        """Pseudo-labelled rows beside labelled ones; of each class they weigh no more than those."""
        share = np.minimum(1.0, self.rows / np.maximum(given.rows, 1))
        return Counts(self.rows + share * given.rows, self.columns + share[:, None] * given.columns)


def fit(counts: Counts, teach: Rows, truth: np.ndarray, strict: bool = True) -> tuple[np.ndarray, float]:
    """Log odds of the columns; ``strict`` shrinks them where the counts do not set the classes apart.

    Odds below ``LEAST_ODDS`` are taken as none, and a column whose chi-square stays below what
    the largest of so many reaches by chance weighs next to nothing: neither the many
    words that go along with a language nor rare words decide.  Margins are bounded, so one telling
    word counts nearly as much as many, and centred between the classes' means in ``teach``.
    """
    width, (none, some) = counts.columns.shape[1], counts.rows
    if not none or not some:
        return np.zeros(width), 40.0 * (bool(some) - bool(none))
    absent, present = counts.columns
    total, found = none + some, absent + present
    expected = found * some / total
    spread = expected * (none / total) * np.maximum(1 - found / total, 1e-9)
    chi = np.where(found > 0, (present - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)
    odds = np.log((present + 0.5) / (some + 1)) - np.log((absent + 0.5) / (none + 1))
    odds[found == 0] = 0.0
    chance = 2 * np.log(max(width, 2))
    weights = odds
    if strict:
        weights = np.where(np.abs(odds) > LEAST_ODDS, odds, 0.0) * chi**SHARP / (chi**SHARP + chance**SHARP)
    sums = teach.dot(weights)
    weights = weights * (STEEP / max(float(np.std(sums)), 1e-9))
    sums = np.tanh(teach.dot(weights))
    middle = sum(float(sums[truth == k].mean()) if (truth == k).any() else 0.0 for k in (0, 1)) / 2
    return weights, -middle


def margin(rows: Rows, model: tuple[np.ndarray, float]) -> np.ndarray:
    return np.tanh(rows.dot(model[0])) + model[1]


def cuts(margins: np.ndarray, target: np.ndarray, sure: float) -> tuple[float, float]:
    """(low, high): margins up to low are surely of class 0, from high on of class 1.

    Each is the widest one whose share of right rows among those kept back is ``sure`` and
    better than always naming the class; where there is none, nothing is handed over.
    """
    out = []
    for k, side in ((0, -margins), (1, margins)):
        order = np.argsort(-side, kind="stable")
        right = np.cumsum(target[order] == k) / np.arange(1, len(order) + 1)
        last = np.append(side[order][1:] < side[order][:-1], True)  # equal margins go together
        good = np.flatnonzero(last & (right >= sure) & (right > np.mean(target == k)) & (side[order] > 0)) if len(order) else []
        edge = side[order][good[-1]] if len(good) else np.inf
        out.append(-edge if k == 0 else edge)
    return out[0], out[1]


def named(margins: np.ndarray, edges: tuple[float, float]) -> np.ndarray:
    """Pseudo-labels: 0, 1, or -1 between the edges."""
    return np.where(margins >= edges[1], 1, np.where(margins <= edges[0], 0, -1))


def handed_over(views: list[Rows], models: list, edges: list, widths: list[int]) -> list[Counts]:
    """What each view is taught by the other one about these unlabelled rows."""
    labels = [named(margin(v, m), e) for v, m, e in zip(views, models, edges, strict=True)]
    return [Counts.of(view, labels[1 - k], width) for k, (view, width) in enumerate(zip(views, widths, strict=True))]


def co_train(views: list[Rows], widths: list[int], labels: np.ndarray, rounds: int = ROUNDS, sure: float = SURE, pool=None):
    """(models by view, calibration) for one target; ``labels`` are 0, 1 or -1 for unlabelled rows.

    Every fifth labelled row is kept back, for the cuts, the calibration, and to choose the
    round with the smallest loss.  In each round both views name the unlabelled rows they are
    sure of, and each is fitted to the labelled rows and those the other one has named.
    ``pool(models, edges)`` gives the counts of unlabelled rows that are not among ``views``.
    """
    labelled = np.flatnonzero(labels >= 0)
    kept_back = labelled[::5]
    teach = np.setdiff1d(labelled, kept_back)
    truth = labels[kept_back].astype(float)
    known = [v.take(teach) for v in views]
    back, here = [v.take(kept_back) for v in views], [v.take(np.flatnonzero(labels < 0)) for v in views]
    counted = [Counts.of(v, labels[teach], w) for v, w in zip(known, widths, strict=True)]

    def fitted(counts: list[Counts], strict: bool) -> list:
        return [fit(c, v, labels[teach], strict) for c, v in zip(counts, known, strict=True)]

    def judged(models: list) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss on the rows kept back, their margins, calibration)."""
        margins = np.stack([margin(v, m) for v, m in zip(back, models, strict=True)], axis=1)
        beta = calibrate(margins, truth)
        chance = np.clip(_sigmoid(margins @ beta[:-1] + beta[-1]), 1e-6, 1 - 1e-6)
        return -float(np.mean(np.log(np.where(truth > 0, chance, 1 - chance)))) if len(truth) else 0.0, margins, beta

    # Whether to shrink is told by the rows kept back: with very few labels there is nothing to tell by.
    strict = min((True, False), key=lambda s: judged(fitted(counted, s))[0])
    models, best = fitted(counted, strict), None
    for turn in range(rounds + 1):
        loss, margins, beta = judged(models)
        if best is not None and loss > best[0]:
            break
        best = loss, models, beta
        edges = [cuts(margins[:, k], truth, sure) for k in range(len(views))]
        if turn == rounds or not np.isfinite(edges).any():
            break
        given = handed_over(here, models, edges, widths)
        if pool is not None:
            given = [Counts(a.rows + b.rows, a.columns + b.columns) for a, b in zip(given, pool(models, edges), strict=True)]
        models = fitted([c.joined(g) for c, g in zip(counted, given, strict=True)], strict)
    return best[1], best[2]


def calibrate(margins: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the margins and a bias: a small logistic regression by Newton steps, smoothed."""
    if not len(target):
        return np.append(np.full(margins.shape[1], 0.5), 0.0)
    x = np.column_stack([margins, np.ones(len(target))])
    beta = np.append(np.full(margins.shape[1], 0.5), 0.0)
    for _ in range(25):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (target - p) - 0.1 * beta
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(curvature, gradient)
    return beta


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, __text, __page): the columns of both views of every document.

    Written once, the table serves all rounds and the scoring, and texts are read once.
    """
    if {"__text", "__page"} <= set(docs.columns):
        return docs.select("doc_id", "__text", "__page")
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars")
    listed = lambda r: pa.ListArray.from_arrays(pa.array(r.first, pa.int32()), pa.array(r.columns.astype(np.int32)))

    def work(table: pa.Table) -> pa.Table:
        views = listed(text_view(table.column("text"))), listed(page_view(table))
        return pa.table([table.column("doc_id"), *views], ["doc_id", "__text", "__page"])

    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType)])
    schema = schema.add("__text", ArrayType(IntegerType())).add("__page", ArrayType(IntegerType()))
    return map_tables(rows, work, schema, "text")


def _views(table: pa.Table) -> list[Rows]:
    out = []
    for name in ("__text", "__page"):
        lists = table.column(name).combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        length = np.asarray(lists.value_lengths(), np.int64) if len(lists) else np.zeros(0, np.int64)
        out.append(Rows(np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(length)])))
    return out


_WIDTHS = [_BUCKETS, _META]


def learn(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> dict[str, tuple]:
    """Models by target, co-trained from labelled documents and all others.

    At most ``labelled`` rows labelled for each target are drawn, by the smallest hashes of
    their ids.  Every other document takes part in the rounds as an unlabelled one: tasks score
    them, name those that a view is sure of, and add up the counts that the other view is
    fitted to; the driver sees these sums, whose number is that of the columns.
    Each target is taught by its own labels: a row that has only one of them is labelled
    for this target and unlabelled for the other.  Of an id with several labels the
    largest counts; rows without an id teach nothing.
    """
    read = docs if {"__text", "__page"} <= set(docs.columns) else materialize(featured(docs), "views")
    found = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TARGETS])
    known = found.where(" OR ".join(f"{t} IS NOT NULL" for t in TARGETS))
    flags = {f"__{t}": F.col(t).isNotNull() for t in TARGETS}
    chosen = smallest_hashes(known.withColumns(flags), labelled, "doc_id", also=dict.fromkeys(flags, labelled))
    taught = [F.coalesce(F.col(t).cast("int"), F.lit(-1)).alias(t) for t in TARGETS]
    rows = read.join(F.broadcast(chosen.select("doc_id", *taught)), "doc_id").select("doc_id", "__text", "__page", *TARGETS)
    order = [("doc_id", "ascending"), *((t, "ascending") for t in TARGETS)]
    sample = rows.toArrow().sort_by(order)  # at most so many rows as were drawn, and their copies
    views = _views(sample)
    return {t: co_train(views, _WIDTHS, np.asarray(sample.column(t), np.int64), pool=_pool(read, chosen)) for t in TARGETS}


#: Columns whose counts travel as one row.
_CHUNK = 1 << 12


def _pool(read: DataFrame, chosen: DataFrame):
    """Counts of what both views name among all documents but the drawn ones, which the driver has.

    A task adds up its rows and sends one row per run of columns, which are added again where
    they meet, so neither a task nor the driver holds more than the columns.
    """
    others = read.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("__text", "__page")

    def counts(models: list, edges: list) -> list[Counts]:
        held = read.sparkSession.sparkContext.broadcast((models, edges))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [Counts.empty(w) for w in _WIDTHS]
            for table in gathered(batches, None, 1 << 22):
                for total, more in zip(sums, handed_over(_views(table), *held.value, _WIDTHS), strict=True):
                    total.rows += more.rows
                    total.columns += more.columns
            parts = {}
            for k, total in enumerate(sums):
                for c in (0, 1):
                    parts[k, c, -1] = total.rows[c : c + 1]
                    for a in range(0, _WIDTHS[k], _CHUNK):
                        if total.columns[c, a : a + _CHUNK].any():
                            parts[k, c, a] = total.columns[c, a : a + _CHUNK]
            yield _part_batch(parts)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for key, n in _parts_of(batch):
                    parts[key] = parts[key] + n if key in parts else n
            yield _part_batch(parts)

        kind = "view int, class int, place int, n array<bigint>"
        met = others.mapInArrow(run, kind).repartition("view", "class", "place").mapInArrow(add, kind)
        out = [Counts.empty(w) for w in _WIDTHS]
        for batch in met.toArrow().to_batches():
            for (view, label, place), n in _parts_of(batch):
                if place < 0:
                    out[view].rows[label] = n[0]
                else:
                    out[view].columns[label, place : place + len(n)] = n
        held.unpersist()
        return out

    return counts


def _part_batch(parts: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys = [pa.array([key[k] for key in parts], pa.int32()) for k in range(3)]
    n = pa.array([v.astype(np.int64) for v in parts.values()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*keys, n], ["view", "class", "place", "n"])


def _parts_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
    for key, n in zip(keys, batch.column(3), strict=True):
        yield key, n.values.to_numpy(zero_copy_only=False)


def score(docs: DataFrame, models: dict[str, tuple]) -> DataFrame:
    """(doc_id, quality, toxic, text and page margins, kept) for every row of ``docs``.

    quality and toxic are calibrated probabilities from both views; kept says that quality
    is at least and toxic below one half.  Null texts and columns count as empty; texts may
    be of any length; repeated rows are judged alike; an empty table gives no rows.  Without
    labels of a class all documents get the other one; without any label quality is 1 half
    and toxic 1 half.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    rows = featured(docs)

    def work(table: pa.Table) -> pa.Table:
        out = table.select(["doc_id"])
        views = _views(table)
        for name in TARGETS:
            by_view, beta = held.value[name]
            margins = np.stack([margin(v, m) for v, m in zip(views, by_view, strict=True)], axis=1)
            out = out.append_column(name, pa.array(_sigmoid(margins @ beta[:-1] + beta[-1])))
            for k, view in enumerate(("text", "page")):
                out = out.append_column(f"{name}_{view}", pa.array(_sigmoid(margins[:, k])))
        return out

    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType)])
    for name in TARGETS:
        for column in (name, f"{name}_text", f"{name}_page"):
            schema = schema.add(column, "double")
    scored = map_tables(rows, work, schema)
    return scored.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
