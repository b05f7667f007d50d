"""Similarity search of query records against a collection.

Words shared by query and collection are seeds; seeds on one diagonal
(d_pos - q_pos) support one another; diagonals with enough seeds are extended,
first without gaps, then with affine gaps, and reported with an e-value.  The
seed search is an equi-join on the word, so the collection is scanned once and
no pair of records is compared unless they share a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions.alignment import LOW, best_end, segments
from recordmill.functions.text import letter_count, letters, text_runs
from recordmill.operators.masking import unmasked
from recordmill.session import materialize

#: Size of the replicated filter of query words at most, as a power of two (128 MiB).
FILTER_BITS = 30
#: Matches of one word that one task joins.
HOT_WORD = 100_000
#: Words of queries that are replicated to the tasks, and the seeds that a task counts.
REPLICATED_WORDS = 1 << 20
TASK_SEEDS = 1 << 20
#: Pairs of one record, and of one partition, that are aligned in one task.
PAIRS_PER_TASK = 1_000


@dataclass(frozen=True)
class Scoring:
    """Residue scores, affine gaps and the statistics that go with them.

    ``matrix`` maps residue pairs to scores; without it ``match`` and
    ``mismatch`` apply.  ``lam`` and ``kappa`` are the Karlin-Altschul parameters of
    just this system (see :func:`fit_statistics`); bits and e-values need them.
    """

    match: int = 5
    mismatch: int = -4
    gap_open: int = 11
    gap_extend: int = 1
    lam: float | None = None
    kappa: float | None = None
    matrix: Mapping[tuple[str, str], int] | None = field(default=None, hash=False)

    def table(self) -> np.ndarray:
        """Scores as a 256 x 256 array indexed by byte values."""
        scores = np.full((256, 256), self.mismatch, dtype=np.int64)
        np.fill_diagonal(scores, self.match)
        for (a, b), value in (self.matrix or {}).items():
            scores[ord(a), ord(b)] = value
        return scores

    def best(self) -> int:
        return max(self.matrix.values()) if self.matrix else self.match

    def statistics(self) -> tuple[float, float]:
        if self.lam is None or self.kappa is None:
            raise ValueError("this scoring system has no statistics: give lam and kappa, or fit them")
        return self.lam, self.kappa

    def bits(self, score: Column) -> Column:
        lam, kappa = self.statistics()
        return (F.lit(lam) * score - math.log(kappa)) / math.log(2)

    def evalue(self, score: Column, query_len: Column, db_len: Column) -> Column:
        lam, kappa = self.statistics()
        return F.lit(kappa) * query_len * db_len * F.exp(F.lit(-lam) * score)


def solve_lambda(scores: np.ndarray, frequencies: np.ndarray) -> float:
    """Lambda of ungapped statistics: the root of sum(p p' exp(lambda s)) = 1."""
    pair = np.outer(frequencies, frequencies)
    if (pair * scores).sum() >= 0:
        raise ValueError("the expected score of a random pair must be negative")
    low, high = 0.0, 1.0
    while (pair * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (pair * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def fit_statistics(scoring: Scoring, frequencies: Mapping[str, float], *, length: int = 300, pairs: int = 400, seed: int = 1) -> Scoring:
    """``scoring`` with lam and kappa fitted to best gapped scores of random pairs.

    The scores follow an extreme-value distribution: its standard deviation gives lam, its
    mean gives kappa.
    """
    draw, table = np.random.default_rng(seed), scoring.table()
    letters, weights = zip(*sorted(frequencies.items()), strict=True)
    codes = np.array([ord(c) for c in letters], np.uint8)
    weights = np.array(weights) / sum(weights)
    best = [
        best_end(*draw.choice(codes, (2, length), p=weights), table, scoring.gap_open, scoring.gap_extend)[0]
        for _ in range(pairs)
    ]
    lam = math.pi / (math.sqrt(6) * float(np.std(best)))
    kappa = math.exp(lam * float(np.mean(best)) - 0.5772156649) / length**2
    return replace(scoring, lam=lam, kappa=kappa)


WINDOW = 32
SCAN_LETTERS = 1 << 16
#: Text that a task scans at a time, unless one record is longer.
SCAN_BYTES = 1 << 22


def words(records: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(id, at, word): every word of ``size`` letters with its 0-based position.

    The record is first cut into overlapping windows by one regular-expression
    pass; ``substring`` on the whole record would be quadratic in its length.
    The outer explode keeps Spark from running that pass again as a size test.
    """
    cut = f"(?=([A-Z]{{{size},{WINDOW + size - 1}}}))[A-Z]{{1,{WINDOW}}}"
    windows = records.select(
        F.col(id_column).alias("id"),
        F.posexplode_outer(F.regexp_extract_all(letters(text), F.lit(cut), F.lit(1))).alias("window", "text"),
    ).where("window IS NOT NULL")
    shifts = windows.select("*", F.explode(F.sequence(F.lit(0), F.length("text") - size)).alias("shift"))
    return shifts.select(
        "id",
        (F.col("window") * WINDOW + F.col("shift")).alias("at"),
        F.substr("text", F.col("shift") + 1, F.lit(size)).alias("word"),
    )


def _rolling_hash(letters: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every window of ``size`` bytes."""
    count = len(letters) - size + 1
    out = np.zeros(max(count, 0), dtype=np.uint64)
    for i in range(size if count > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += letters[i : i + count]
    return out ^ (out >> np.uint64(29))


def word_filter(wanted: DataFrame, size: int, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bitmap of the hashes of ``wanted.word``, set together by the tasks.

    It has about 64 bits per word up to ``most_bits``; a fuller one lets more other words
    through, which the later join on the word removes.
    """
    count = wanted.select(F.approx_count_distinct("word")).first()[0]
    bits = min(most_bits, max(16, (count * 64).bit_length()))
    mask = np.uint64((1 << bits) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.frombuffer("".join(batch.column(0).to_pylist()).encode("ascii"), np.uint8)
            at = np.unique(_rolling_hash(packed, size)[::size] & mask).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    places = wanted.select("word").distinct().mapInArrow(place, "at BIGINT").distinct()
    table = np.zeros(1 << bits >> 3, np.uint8)
    # One row per 32,768 bits, each of bounded size.
    blocks = places.groupBy(F.expr("at div 32768").alias("block")).agg(F.collect_list(F.expr("at % 32768")).alias("bits"))
    for block, inside in blocks.toLocalIterator():
        part = np.zeros(32768, bool)
        part[inside] = True
        table[block * 4096 : block * 4096 + 4096] = np.packbits(part)
    return table


def matching_words(records: DataFrame, id_column: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """The rows of :func:`words` whose word may be in ``wanted.word``; none that is gets lost.

    Listing each word of the collection as a row costs far more than looking at
    it, so a bitmap of word hashes is tested over the Arrow buffers and only hits
    become rows.  A hit can be a hash collision; callers join on the word.
    """
    packed = word_filter(wanted, size)
    bits = len(packed) * 8
    mask = np.uint64(bits - 1)
    shared = records.sparkSession.sparkContext.broadcast(packed)
    upper = np.zeros(256, dtype=np.uint8)
    for letter in range(26):
        upper[[65 + letter, 97 + letter]] = 65 + letter

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in (run for batch in batches for run in text_runs(batch, "text", SCAN_BYTES)):
            column = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            # Bytes of longer UTF-8 characters are above the letters, so the
            # letters of a record can be picked byte by byte.
            data, offsets = upper[data], offsets - offsets[0]
            kept = [np.count_nonzero(data[first:last]) for first, last in zip(offsets, offsets[1:])]
            data, starts = data[data > 0], np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
            near = [np.zeros(0, dtype=np.int64)]
            for begin in range(0, len(data) - size + 1, SCAN_LETTERS):
                part = data[begin : begin + SCAN_LETTERS + size - 1]
                at = _rolling_hash(part, size) & mask
                near.append(begin + np.flatnonzero(table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1))
            hits = np.concatenate(near)
            owner = np.searchsorted(starts, hits, side="right") - 1
            inside = hits + size <= starts[owner + 1]
            hits, owner = hits[inside], owner[inside]
            found = data[hits[:, None] + np.arange(size)].tobytes().decode("ascii")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(owner)),
                    pa.array((hits - starts[owner]).astype(np.int32)),
                    pa.array([found[i : i + size] for i in range(0, len(found), size)], pa.string()),
                ],
                names=["id", "at", "word"],
            )

    narrow = records.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"id {id_type}, at INT, word STRING")


def seeds(
    queries: DataFrame,
    collection: DataFrame,
    id_column: str,
    text: str,
    *,
    size: int,
    min_seeds: int = 2,
    mask: DataFrame | None = None,
    query_mask: DataFrame | None = None,
) -> DataFrame:
    """(query_id, db_id, diagonal, seeds): diagonals holding at least ``min_seeds`` words.

    Words that meet an interval of ``mask`` in the collection, or of ``query_mask`` in a query
    (see :mod:`recordmill.operators.masking`), are no seeds.

    The collection is scanned where it lies, past a replicated filter of bounded size that
    the tasks build from the query words; only words that pass become rows.  These are
    joined with the query words; a word with many matches is dealt over as many tasks as
    its count asks for.  Seeds are counted map-side before the shuffle on (query, record,
    diagonal).
    """
    asked = words(queries, id_column, text, size)
    if query_mask is not None:
        asked = unmasked(asked, query_mask, size)
    wanted = asked.select(F.col("id").alias("query_id"), F.col("at").alias("q_at"), "word")
    return seeds_of_words(wanted, collection, id_column, text, size=size, min_seeds=min_seeds, mask=mask)


def seeds_of_words(
    wanted: DataFrame,
    collection: DataFrame,
    id_column: str,
    text: str,
    *,
    size: int,
    min_seeds: int,
    mask: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`seeds` for any words ``wanted`` (query_id, q_at, word)."""
    wanted = materialize(wanted, "query-words")
    offered = matching_words(collection, id_column, text, size, wanted)
    if mask is not None:
        offered = unmasked(offered, mask, size)
    offered = materialize(offered, "matches")
    counts = offered.groupBy("word").agg(F.count("*").alias("n"))
    if wanted.count() <= REPLICATED_WORDS:
        # Seeds of a record meet in one task, which counts them where they are made: a diagonal
        # with too few of them is never shuffled.  Tasks are as many as the seeds ask for.
        asked = wanted.groupBy("word").agg(F.count("*").alias("m"))
        total = counts.join(F.broadcast(asked), "word").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        tasks = max(_partitions(wanted.sparkSession), math.ceil(total / TASK_SEEDS))
        placed = offered.select(F.col("id").alias("db_id"), F.col("at").alias("d_at"), "word").repartition(tasks, "db_id")
        met = placed.join(F.broadcast(wanted), "word")
    else:
        # At most one row per HOT_WORD matches.
        hot = F.broadcast(counts.where(F.col("n") > HOT_WORD).select("word", F.ceil(F.col("n") / HOT_WORD).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        offered = offered.join(hot, "word", "left").withColumn("part", F.pmod(F.hash("id", "at"), parts))
        wanted = wanted.join(hot, "word", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        met = offered.select(F.col("id").alias("db_id"), F.col("at").alias("d_at"), "word", "part").join(
            wanted.drop("parts"), ["word", "part"]
        )
    return (
        met.groupBy("query_id", "db_id", (F.col("d_at") - F.col("q_at")).alias("diagonal"))
        .agg(F.count("*").alias("seeds"))
        .where(F.col("seeds") >= min_seeds)
    )


def _paired(found: DataFrame, queries: DataFrame, collection: DataFrame, id_column: str, text: str) -> DataFrame:
    """Found pairs with both sequences; texts are reduced to letters after the join."""
    q = queries.select(F.col(id_column).alias("query_id"), F.col(text).alias("q_text"))
    d = collection.select(F.col(id_column).alias("db_id"), F.col(text).alias("d_text"))
    joined = found.join(q, "query_id").join(d, "db_id")
    return joined.select(*found.columns, letters("q_text").alias("q_seq"), letters("d_text").alias("d_seq"))


def extend_ungapped(
    found: DataFrame, queries: DataFrame, collection: DataFrame, id_column: str, text: str, scoring: Scoring
) -> DataFrame:
    """(query_id, db_id, diagonal, seeds, q_len, d_len, score, q_from, q_to, d_from, d_to).

    The best-scoring stretch of each diagonal, positions 1-based and inclusive.
    Only the overlap of the two records on the diagonal is sent to Python.
    """
    table = scoring.table()

    @F.pandas_udf("score BIGINT, first INT, last INT")
    def best_stretch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_best_stretch(_gains(x, y, table)) for x, y in zip(a, b)], columns=["score", "first", "last"])

    cut = _overlaps(found, queries, collection, id_column, text)
    return _placed(cut.withColumn("hit", best_stretch("a", "b")))


def ungapped_segments(
    found: DataFrame, queries: DataFrame, collection: DataFrame, id_column: str, text: str, scoring: Scoring, least: int
) -> DataFrame:
    """The columns of :func:`extend_ungapped`, one row per stretch of at least ``least``.

    After the best stretch of a diagonal, what lies before and behind it is searched again.
    """
    table = scoring.table()

    @F.pandas_udf("array<struct<score:bigint,first:int,last:int>>")
    def stretches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_stretches(_gains(x, y, table), least) for x, y in zip(a, b)])

    cut = _overlaps(found, queries, collection, id_column, text)
    # As in align_pairs: evaluated once, not again in a filter.
    return _placed(cut.withColumn("hit", F.explode(stretches.asNondeterministic()("a", "b"))))


def _overlaps(found: DataFrame, queries: DataFrame, collection: DataFrame, id_column: str, text: str) -> DataFrame:
    """Found diagonals with the parts ``a`` and ``b`` of both records that lie on them."""
    start = F.greatest(F.lit(0), -F.col("diagonal"))
    stop = F.least(F.length("q_seq"), F.length("d_seq") - F.col("diagonal"))
    return _paired(found, queries, collection, id_column, text).select(
        "query_id",
        "db_id",
        "diagonal",
        "seeds",
        F.length("q_seq").alias("q_len"),
        F.length("d_seq").alias("d_len"),
        start.alias("start"),
        F.substr("q_seq", start + 1, stop - start).alias("a"),
        F.substr("d_seq", start + F.col("diagonal") + 1, stop - start).alias("b"),
    )


def _placed(scored: DataFrame) -> DataFrame:
    q_from = F.col("start") + F.col("hit.first") + 1
    q_to = F.col("start") + F.col("hit.last") + 1
    return scored.select(
        "query_id",
        "db_id",
        "diagonal",
        "seeds",
        "q_len",
        "d_len",
        F.col("hit.score").alias("score"),
        q_from.alias("q_from"),
        q_to.alias("q_to"),
        (q_from + F.col("diagonal")).alias("d_from"),
        (q_to + F.col("diagonal")).alias("d_to"),
    )


def _gains(a: str, b: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)]


def _stretches(gains: np.ndarray, least: int) -> list[dict[str, int]]:
    """Best stretch, and those of what is left on both sides, down to a score of ``least``."""
    out, open_ = [], [(0, len(gains))]
    while open_:
        a, b = open_.pop()
        if b > a:
            score, first, last = _best_stretch(gains[a:b])
            if score >= least:
                out.append({"score": score, "first": a + first, "last": a + last})
                open_ += [(a, a + first), (a + last + 1, b)]
    return out


def _best_stretch(gains: np.ndarray) -> tuple[int, int, int]:
    """Score, first and last index of the best run; the earliest end, then the latest start, wins."""
    sums = np.concatenate([[0], np.cumsum(gains)])
    lowest = np.minimum.accumulate(sums)
    gains = sums[1:] - lowest[:-1]
    last = int(gains.argmax())
    first = int(np.flatnonzero(sums[: last + 1] == lowest[last])[-1])
    return int(gains[last]), first, last


SEGMENT = (
    "score BIGINT, q_from INT, q_to INT, d_from INT, d_to INT, identities INT, gaps INT, q_aligned STRING, d_aligned STRING"
)


def align_pairs(
    found: DataFrame,
    queries: DataFrame,
    collection: DataFrame,
    id_column: str,
    text: str,
    scoring: Scoring,
    least: Column,
) -> DataFrame:
    """(query_id, db_id, q_len, d_len, segment, score, ...): gapped alignments of seeded pairs.

    ``least`` is the score a segment needs, from ``q_len``.  Every alignment that a seeded
    diagonal can be part of is searched (see ``functions.alignment.segments``), so the best
    one is the best of all that hold a seed.  Texts are reduced to letters once per record.
    The pairs of a record that meets very many queries are dealt over several tasks.
    """
    pairs = found.groupBy("query_id", "db_id").agg(F.collect_set("diagonal").alias("diagonals"))
    pairs = materialize(pairs, "pairs")
    # Aligning costs far more than reading: the number of tasks follows the pairs, not their bytes;
    # several for each slot even out pairs of different lengths.
    counts = pairs.groupBy("db_id").agg(F.count("*").alias("n"))
    tasks = max(4 * _partitions(pairs.sparkSession), -(-pairs.count() // PAIRS_PER_TASK))
    # At most one row per PAIRS_PER_TASK pairs.
    hot = F.broadcast(counts.where(F.col("n") > PAIRS_PER_TASK).select("db_id", F.ceil(F.col("n") / PAIRS_PER_TASK).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))

    def side(df: DataFrame, name: str, short: str) -> DataFrame:
        met = df.join(pairs.select(F.col(name).alias(id_column)).distinct(), id_column, "left_semi")
        return met.select(F.col(id_column).alias(name), letters(text).alias(f"{short}_seq"))

    dealt = side(collection, "db_id", "d").join(hot, "db_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    open_, more, best = scoring.gap_open, scoring.gap_extend, scoring.best()
    joined = (
        pairs.join(hot, "db_id", "left")
        .withColumn("part", F.pmod(F.hash("query_id"), parts))
        .drop("parts")
        .join(side(queries, "query_id", "q"), "query_id")
        .repartition(tasks, "db_id", "part")
        .join(dealt.drop("parts"), ["db_id", "part"])
        .select("*", F.length("q_seq").alias("q_len"), F.length("d_seq").alias("d_len"))
        .withColumn("least", least.cast("long"))
    )
    # Only what lies within reach of the seeded diagonals is sent to Python.
    most = F.col("q_len").cast("long") * best - open_ - F.col("least")
    reach = F.greatest(F.lit(0), F.floor(most / more)) if more else F.col("d_len").cast("long")
    skip = F.greatest(F.lit(0), F.array_min("diagonals") - reach).cast("int")
    upto = F.least("d_len", F.array_max("diagonals") + F.col("q_len") + reach).cast("int")
    table = scoring.table()

    @F.pandas_udf(f"array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")
    def align(q: pd.Series, d: pd.Series, diagonals: pd.Series, least: pd.Series) -> pd.Series:
        rows = zip(q, d, diagonals, least, strict=True)
        return pd.Series([[vars(s) for s in segments(a, b, list(c), table, open_, more, int(n))] for a, b, c, n in rows])

    # A deterministic function would be evaluated once more, in a filter on the size of its array.
    align = align.asNondeterministic()
    joined = joined.withColumns({"skip": skip, "upto": upto})
    near = F.substr("d_seq", F.col("skip") + 1, F.col("upto") - F.col("skip"))
    moved = F.transform("diagonals", lambda x: x - F.col("skip"))
    aligned = joined.select("query_id", "db_id", "q_len", "d_len", "skip", align("q_seq", near, moved, "least").alias("all"))
    placed = lambda c: (F.col(f"hit.{c}") + F.col("skip")).alias(c)
    return aligned.select("query_id", "db_id", "q_len", "d_len", "skip", F.posexplode("all").alias("segment", "hit")).select(
        "query_id", "db_id", "q_len", "d_len", (F.col("segment") + 1).alias("segment"),
        "hit.score", "hit.q_from", "hit.q_to", placed("d_from"), placed("d_to"), "hit.identities", "hit.gaps",
        "hit.q_aligned", "hit.d_aligned",
    )


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def search(
    queries: DataFrame,
    collection: DataFrame,
    id_column: str = "id",
    text: str = "text",
    *,
    size: int = 3,
    min_seeds: int = 2,
    scoring: Scoring,
    max_evalue: float = 10.0,
    mask: DataFrame | None = None,
    query_mask: DataFrame | None = None,
) -> DataFrame:
    """Hits of every query in the collection: all segments of a pair, the best one first.

    Masks are soft: masked words are no seeds, but alignments may run through them.

    Returns query_id, db_id, q_len, d_len, segment, score, bits, evalue, the 1-based bounds,
    identities, gaps and the aligned strings.  Expected hits are measured against all letters
    of the collection; ``scoring`` must carry its statistics.
    """
    lam, kappa = scoring.statistics()
    found = seeds(
        queries, collection, id_column, text, size=size, min_seeds=min_seeds, mask=mask, query_mask=query_mask
    )
    total = float(collection.agg(F.sum(letter_count(text))).first()[0] or 0)
    # A smaller score has an e-value above max_evalue.
    least = F.greatest(F.lit(1), F.floor(F.log(F.lit(kappa * total / max_evalue) * F.col("q_len")) / lam))
    aligned = align_pairs(found, queries, collection, id_column, text, scoring, least)
    hits = aligned.withColumn("bits", scoring.bits(F.col("score"))).withColumn(
        "evalue", scoring.evalue(F.col("score"), F.col("q_len"), F.lit(total))
    )
    return hits.where(F.col("evalue") <= max_evalue).select(
        "query_id", "db_id", "q_len", "d_len", "segment", "score", "bits", "evalue", "q_from", "q_to", "d_from", "d_to",
        "identities", "gaps", "q_aligned", "d_aligned",
    )


# Least score of each strength, for a match at an end and inside.
SCREEN_STRENGTHS = {"strong": (24, 30), "moderate": (19, 25), "weak": (16, 23)}
SCREEN_END = 25
SCREEN_SCORING = Scoring(match=1, mismatch=-5)


def screen_strength(score: Column, q_from: Column, q_to: Column, q_len: Column) -> Column:
    """Strength of a contaminating match; NULL below the weakest."""
    at_end = (q_from <= SCREEN_END) | (q_to > q_len - SCREEN_END)
    out = F.lit(None).cast("string")
    for name, (end, inside) in reversed(SCREEN_STRENGTHS.items()):
        out = F.when(score >= F.when(at_end, end).otherwise(inside), name).otherwise(out)
    return out


def screen(
    records: DataFrame, contaminants: DataFrame, id_column: str, text: str, *, size: int = 6, min_seeds: int | None = None
) -> DataFrame:
    """(record_id, contaminant_id, q_from, q_to, score, strength): all screened segments.

    No segment is missed with the default seeds: one that scores s with m other letters in it has
    m + 1 runs of s + 5m equal letters in all, and so at least s + 5m - 5(m + 1) = s - 5 words of
    six, all on one diagonal.  Larger words are faster, but miss segments whose other letters
    stand close: words of 11 are sure to find only segments with one other letter.
    """
    if min_seeds is None:
        least = min(min(pair) for pair in SCREEN_STRENGTHS.values())
        min_seeds = least + SCREEN_SCORING.mismatch if size == 6 else 1
    found = seeds(contaminants, records, id_column, text, size=size, min_seeds=min_seeds)
    weakest = min(min(pair) for pair in SCREEN_STRENGTHS.values())
    flat = ungapped_segments(found, contaminants, records, id_column, text, SCREEN_SCORING, weakest)
    strength = screen_strength(F.col("score"), F.col("d_from"), F.col("d_to"), F.col("d_len"))
    return flat.select(
        F.col("db_id").alias("record_id"),
        F.col("query_id").alias("contaminant_id"),
        F.col("d_from").alias("q_from"),
        F.col("d_to").alias("q_to"),
        "score",
        strength.alias("strength"),
    ).where("strength IS NOT NULL")


def profile_diagonals(
    profiles: DataFrame, collection: DataFrame, id_column: str, text: str, *, size: int = 3, min_seeds: int = 2
) -> DataFrame:
    """(profile_id, db_id, diagonal, score): best ungapped profile match per seeded diagonal.

    ``profiles`` has profile_id, consensus and ``scores``, one map from residue
    to score per position.  Seeds are exact words of the consensus; see
    :func:`profile_search` for matches that hold none.
    """
    models = profiles.select(F.col("profile_id").alias(id_column), F.col("consensus").alias(text))
    found = seeds(models, collection, id_column, text, size=size, min_seeds=min_seeds)
    start = F.greatest(F.lit(0), -F.col("diagonal"))
    wide = (
        found.withColumnRenamed("query_id", "profile_id")
        .join(profiles, "profile_id")
        .join(collection.select(F.col(id_column).alias("db_id"), F.col(text).alias("d_text")), "db_id")
        .withColumn("d_seq", letters("d_text"))
    )
    span = F.least(F.size("scores"), F.length("d_seq") - F.col("diagonal")) - start
    residues = F.split(F.substr("d_seq", start + F.col("diagonal") + 1, span), "")
    gains = F.zip_with(
        F.slice("scores", start + 1, span), residues, lambda s, c: F.coalesce(F.try_element_at(s, c), F.lit(-1))
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, gain: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + gain)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    score = F.aggregate(gains, zero, step, lambda acc: acc["best"])
    return wide.select("profile_id", "db_id", "diagonal", score.alias("score"))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sure_threshold(columns: Column, size: int, least: Column, gap: int) -> Column:
    """The largest word threshold that misses no alignment scoring ``least``.

    An alignment with g gaps has g + 1 stretches without gaps, the best of which scores the
    smaller of ``least`` and ``gap`` at least (``gap`` is the cost of a gap's first place).  If
    no word of a stretch scored t, each of its ceil(columns / size) consecutive words would add
    t - 1 at most.
    """
    return F.greatest(F.lit(1), F.floor((F.least(least, F.lit(gap)) - 1) / F.ceil(columns / size)) + 1)


def profile_words(profiles: DataFrame, size: int) -> DataFrame:
    """(query_id, q_at, word): the words scoring ``threshold`` or more at a place of their profile.

    ``profiles`` has profile_id, ``columns`` (per position the scores of A to Z) and ``threshold``.
    Letters are added column by column, and a beginning is dropped once the best rest cannot
    lift it to the threshold (branch and bound), so no word that fails becomes a row.
    """
    at = F.explode(F.sequence(F.lit(0), F.size("columns") - size)).alias("q_at")
    open_ = profiles.where(F.size("columns") >= size).select("profile_id", "threshold", "columns", at)
    open_ = open_.select(
        F.col("profile_id").alias("query_id"),
        "q_at",
        "threshold",
        F.slice("columns", F.col("q_at") + 1, F.lit(size)).alias("window"),
        F.lit("").alias("word"),
        F.lit(0).alias("sum"),
    )
    letters_ = F.array(*[F.lit(c) for c in ALPHABET])
    for k in range(size):
        rest = F.aggregate(F.slice("window", k + 2, size), F.lit(0), lambda total, column: total + F.array_max(column))
        needed = F.col("threshold") - F.col("sum") - rest
        choices = F.filter(F.arrays_zip(letters_.alias("letter"), F.col("window")[k].alias("gain")), _reaching(needed))
        open_ = open_.select("*", F.explode(choices).alias("choice")).select(
            "query_id",
            "q_at",
            "threshold",
            "window",
            F.concat("word", "choice.letter").alias("word"),
            (F.col("sum") + F.col("choice.gain")).alias("sum"),
        )
    return open_.select("query_id", "q_at", "word")


def _reaching(needed: Column):
    return lambda choice: choice["gain"] >= needed


def profile_search(
    profiles: DataFrame,
    collection: DataFrame,
    id_column: str,
    text: str,
    *,
    lam: float,
    kappa: float,
    size: int = 3,
    threshold: int | None = None,
    min_seeds: int = 1,
    other: int = -1,
    gap_open: int = 11,
    gap_extend: int = 1,
    max_evalue: float = 10.0,
) -> DataFrame:
    """The best position-specific alignment of every profile and record that meet.

    ``profiles`` has profile_id and ``scores``, one map from letter to score per position;
    letters it does not name score ``other``.  The seeds are neighbourhood words: all words that
    score ``threshold`` at their place of the profile, wherever the consensus differs.  Diagonals
    with ``min_seeds`` of them are extended without gaps, and pairs with a good enough stretch
    are aligned with affine gaps, within reach of such diagonals.  The rows are
    profile_id, db_id, columns, d_len, score, evalue and the 1-based bounds p_from, p_to,
    d_from, d_to, for e-values up to ``max_evalue`` under ``lam`` and ``kappa``.

    Without a threshold the one of :func:`sure_threshold` is taken: then no pair
    with such an e-value is missed.  Larger thresholds are faster for long profiles.
    """
    total = float(collection.agg(F.sum(letter_count(text))).first()[0] or 0)
    first = gap_open + gap_extend
    count = F.size("scores")
    least = F.greatest(F.lit(1), F.ceil(F.log(F.lit(kappa * total / max_evalue) * count) / lam)).cast("long")
    column = lambda m: F.array(*[F.coalesce(F.try_element_at(m, F.lit(c)), F.lit(other)).cast("int") for c in ALPHABET])
    models = materialize(
        profiles.where(count > 0)
        .select("profile_id", F.transform("scores", column).alias("columns"), count.alias("count"), least.alias("least"))
        .withColumn("trigger", F.least("least", F.lit(first)))
        .withColumn("threshold", F.lit(threshold) if threshold is not None else sure_threshold(F.col("count"), size, F.col("least"), first)),
        "profiles",
    )
    found = seeds_of_words(profile_words(models, size), collection, id_column, text, size=size, min_seeds=min_seeds)
    pairs = materialize(found.groupBy("query_id", "db_id").agg(F.collect_set("diagonal").alias("diagonals")), "pairs")
    wanted = pairs.select(F.col("db_id").alias(id_column)).distinct()
    records = collection.join(wanted, id_column, "left_semi").select(F.col(id_column).alias("db_id"), letters(text).alias("d_seq"))
    # Gap places of an alignment that still scores ``least``, if every column gives its best.
    most = F.aggregate("columns", F.lit(0).cast("long"), lambda s, c: s + F.greatest(F.lit(0), F.array_max(c)))
    reach = F.floor((most - gap_open - F.col("least")) / gap_extend) if gap_extend else F.lit((1 << 31) - 1)
    joined = (
        pairs.join(models.withColumnRenamed("profile_id", "query_id"), "query_id")
        .join(records, "db_id")
        .withColumn("reach", F.greatest(F.lit(0), reach))
        .withColumn("skip", F.greatest(F.lit(0), F.array_min("diagonals") - F.col("reach")))
        .withColumn("upto", F.least(F.length("d_seq"), F.array_max("diagonals") + F.col("count") + F.col("reach")))
    )

    @F.pandas_udf("score BIGINT, p_from INT, p_to INT, d_from INT, d_to INT")
    def align(
        profile: pd.Series, columns: pd.Series, d: pd.Series, diagonals: pd.Series, reach: pd.Series, trigger: pd.Series, least: pd.Series
    ) -> pd.DataFrame:
        best = np.zeros((len(d), 5), np.int64)
        for rows in profile.groupby(profile, sort=False).indices.values():
            k = rows[0]
            given = (np.stack(columns[k]), d.iloc[rows].tolist(), diagonals.iloc[rows].tolist(), int(reach[k]), int(trigger[k]), int(least[k]))
            best[rows] = best_profile_matches(*given, gap_open, gap_extend)
        return pd.DataFrame(best, columns=["score", "p_from", "p_to", "d_from", "d_to"])

    # Only what lies within reach of the seeded diagonals is sent to Python.
    part = F.substr("d_seq", F.col("skip").cast("int") + 1, (F.col("upto") - F.col("skip")).cast("int"))
    moved = F.transform("diagonals", lambda x: x - F.col("skip"))
    aligned = joined.select(
        F.col("query_id").alias("profile_id"), "db_id", F.col("count").alias("columns"), F.length("d_seq").alias("d_len"), "skip",
        align("query_id", "columns", part, moved, "reach", "trigger", "least").alias("hit"),
    ).where("hit.score > 0")
    score = F.col("hit.score")
    evalue = F.lit(kappa * total) * F.col("columns") * F.exp(F.lit(-lam) * score)
    place = lambda c: (F.col(f"hit.{c}") + F.col("skip")).cast("int").alias(c)
    hits = aligned.select(
        "profile_id", "db_id", "columns", "d_len", score.alias("score"), evalue.alias("evalue"),
        "hit.p_from", "hit.p_to", place("d_from"), place("d_to"),
    )
    return hits.where(F.col("evalue") <= max_evalue)


def best_profile_matches(
    columns: np.ndarray,
    texts: list[str],
    diagonals: list[np.ndarray],
    reach: int,
    trigger: int,
    least: int,
    gap_open: int,
    gap_extend: int,
) -> np.ndarray:
    """Per text (score, p_from, p_to, d_from, d_to) of the best alignment scoring ``least``, else zeros.

    ``columns`` has a row of 26 scores per position.  Diagonals count only with a stretch of
    ``trigger`` or more; what lies within ``reach`` of one is searched, near ones together.
    The stretches of all texts are aligned side by side.
    """
    x, out = np.arange(len(columns)), np.zeros((len(texts), 5), np.int64)
    regions: list[tuple[int, int, np.ndarray]] = []
    for k, (text, found) in enumerate(zip(texts, diagonals, strict=True)):
        y, upto = np.frombuffer(text.encode("ascii"), np.uint8) - 65, None
        for diagonal in sorted(int(v) for v in found):
            a, b = max(0, -diagonal), min(len(x), len(y) - diagonal)
            if b <= a or _best_stretch(columns[x[a:b], y[a + diagonal : b + diagonal]])[0] < trigger:
                continue
            low, high = max(0, diagonal - reach), min(len(y), diagonal + len(x) + reach)
            if upto is not None and low <= upto:
                regions[-1] = (k, regions[-1][1], y[regions[-1][1] : max(high, upto)])
                upto = max(high, upto)
            else:
                regions.append((k, low, y[low:high]))
                upto = high
    if not regions:
        return out
    scores, ends_x, ends_y = _best_ends(columns, [y for _, _, y in regions], gap_open, gap_extend)
    for (k, low, y), score, end_x, end_y in zip(regions, scores.tolist(), ends_x.tolist(), ends_y.tolist(), strict=True):
        if score >= max(least, 1) and score > out[k, 0]:
            back = best_end(x[:end_x][::-1], y[:end_y][::-1], columns, gap_open, gap_extend, local=False)
            out[k] = (score, end_x - back[1] + 1, end_x, low + end_y - back[2] + 1, low + end_y)
    return out


def _best_ends(columns: np.ndarray, parts: list[np.ndarray], gap_open: int, gap_extend: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, positions, letters) where the best local alignment with each of ``parts`` ends."""
    size = np.array([len(p) for p in parts])
    y, start = np.concatenate(parts), np.cumsum(size) - size
    part = np.repeat(np.arange(len(parts)), size)
    # Each part lies this much higher than the one before, so no gap reaches back into that.
    lift = part.astype(np.int64) << 40
    slope = gap_extend * np.arange(len(y), dtype=np.int64) + lift
    row, down, across = np.zeros(len(y), np.int64), np.full(len(y), LOW), np.full(len(y), LOW)
    best, end_x, end_y = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for i in range(len(columns)):
        down = np.maximum(down - gap_extend, row - gap_open - gap_extend)
        before = np.roll(row, 1)
        before[start] = 0
        fresh = np.maximum(np.maximum(before + columns[i][y], down), 0)
        across[1:] = np.maximum.accumulate(fresh + slope)[:-1] - slope[1:] - gap_open
        row = np.maximum(fresh, across)
        most = np.maximum.reduceat(row, start)
        better = most > best
        if better.any():
            at = np.flatnonzero((row == most[part]) & better[part])
            which, first = np.unique(part[at], return_index=True)
            best[which], end_x[which], end_y[which] = most[which], i + 1, at[first] - start[which] + 1
    return best, end_x, end_y


def distinct_words(alphabet: str, size: int) -> Iterator[str]:
    """Every word of ``size`` letters once: windows of a de Bruijn sequence."""
    cycle = de_bruijn(alphabet, size)
    wrapped = cycle + cycle[: size - 1]
    return (wrapped[i : i + size] for i in range(len(cycle)))


def de_bruijn(alphabet: str, size: int) -> str:
    """Cyclic string holding each word once: greedy, preferring the last letter."""
    word, seen, out = alphabet[0] * size, set(), []
    while True:
        for letter in reversed(alphabet):
            step = word[1:] + letter
            if step not in seen:
                seen.add(step)
                out.append(letter)
                word = step
                break
        else:
            return "".join(out)
