"""Spelling variants by an index of variable-length grams.

``word_counts`` counts the words of whole texts.  ``near_pairs`` finds all pairs of words that
differ by one inserted, deleted or replaced letter:

1. Words stand between two marks.  The dictionary holds the grams of 2 to ``LONGEST`` letters
   that more than some number of words hold (frequent ones); all others are pruned.  That
   number grows with the words, so the dictionary has at most ``DICTIONARY`` entries.
2. A word is decomposed into one gram for each place: the shortest one there that is not
   frequent, or else the one as long as the word's bound on length.  What a gram is depends on
   its own letters alone, so one edit affects only the grams that span it.
3. Two grams of a word that do not overlap have an affected-gram bound of one: whatever the
   edit, one of them stands unchanged in the other word, at its distance from the start or
   from the end.  Bounds on length are half a word, so such grams always exist; a word is looked
   up under its two rarest ones.  The lists of both are merged inside hash partitions, and
   every pair met is verified letter by letter.

Lists of frequent grams are dealt over several partitions by their counts.  The letters are
those of Latin-1, one byte each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.textarrays import gathered, lower_ascii, mixed, prepare, span_hashes, text_bytes
from recordmill.session import materialize

#: Letters of the longest gram: eight bytes are one number.
LONGEST = 8
#: Most entries of the dictionary (16 bytes each), and the least count of a frequent gram.
DICTIONARY, FREQUENT = 1 << 19, 64
#: Postings of one key in one partition, about, and pairs verified at a time.
LIST_ROWS, PAIRS = 1 << 14, 1 << 19
#: Bytes of text handled at a time; words handled at a time.
RUN_BYTES, RUN_WORDS = 4 << 20, 1 << 15

_U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of what each of ``begun`` is the crc32 of, followed by a span of ``data``."""
    order = np.argsort(start - end, kind="stable")  # longest first
    at, length = start[order], (end - start)[order]
    state = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    steps = 64
    for k in range(min(steps, int(length[0]) if len(length) else 0)):
        n = int(np.searchsorted(-length, -k, "left"))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-length, -steps, "left"))):
        state[k] = zlib.crc32(data[at[k] + steps : at[k] + length[k]].tobytes(), int(state[k]))
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out


def word_counts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_letters: int = 7, min_count: int = 2, spoil: int = 31
) -> DataFrame:
    """(word, n): words of at least ``min_letters`` code points found ``min_count`` times.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.  With
    h the crc32 of ``<doc_id>:<run>``, a run whose h ``spoil`` divides has lost the letter
    h modulo its length (``spoil`` 0 leaves all runs as they are).  Null and empty texts have
    no words; a null id reads as an empty one; repeated rows count each.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", RUN_BYTES):
            words, counts = _counted(table, min_letters, spoil)
            columns = pa.table({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})
            yield from columns.to_batches(max_chunksize=1 << 14)
        pa.default_memory_pool().release_unused()

    counted = source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _counted(table: pa.Table, min_letters: int, spoil: int) -> tuple[list[str], list[int]]:
    data, offsets = text_bytes(table.column("text"))
    low = lower_ascii(data)
    member = _LETTER[data]
    lead = np.flatnonzero(data == _LEAD)
    member[lead] = member[lead + 1] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[heads] = member[heads]
    ends = member.copy()
    ends[:-1] &= ~member[1:]
    ends[heads[1:] - 1] = member[heads[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del begins, ends, member
    letters = end - start - (np.searchsorted(lead, end) - np.searchsorted(lead, start))
    enough = letters >= min_letters
    start, end, letters = start[enough], end[enough], letters[enough]
    if not len(start):
        return [], []
    owner = np.searchsorted(offsets, start, "right") - 1
    _, first, which = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
    pair, times = np.unique(owner * len(first) + which, return_counts=True)
    owner, which = pair // len(first), pair % len(first)
    start, end, letters = start[first], end[first], letters[first]
    spoilt: dict[str, int] = {}
    clean = np.ones(len(pair), bool)
    if spoil:
        begun = np.array([zlib.crc32(f"{k}:".encode()) for k in table.column("doc_id").to_pylist()], np.uint32)
        crc = crc_spans(low, start[which], end[which], begun[owner])
        clean = crc % np.uint32(spoil) != 0
        for k in np.flatnonzero(~clean):
            w = which[k]
            if letters[w] > min_letters:
                word, gone = low[start[w] : end[w]].tobytes().decode(), int(crc[k]) % int(letters[w])
                word = word[:gone] + word[gone + 1 :]
                spoilt[word] = spoilt.get(word, 0) + int(times[k])
    total = np.bincount(which[clean], times[clean], len(first)).astype(np.int64)
    some = np.flatnonzero(total)
    raw = low.tobytes()
    words = [raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
    return [*words, *spoilt], [*total[some].tolist(), *spoilt.values()]


# --- grams ---


@dataclass
class Marked:
    """Words between their marks as bytes, one after another; ``first`` has each one's place."""

    data: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Marked:
        coded = [w.encode("latin-1") for w in words]
        length = np.array([len(w) + 2 for w in coded], np.int64)
        data = b"\x01" + b"\x02\x01".join(coded) + b"\x02" if coded else b""
        return cls(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(length)]))

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.first)

    def codes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(q, code of the gram of q letters at each place, whether the word goes so far)."""
        end = np.repeat(self.first[1:], self.length)
        at, code = np.arange(len(self.data)), self.data.astype(_U64)
        padded = np.concatenate([code, np.zeros(LONGEST, _U64)])
        for q in range(2, LONGEST + 1):
            code = (code << _U64(8)) | padded[q - 1 : q - 1 + len(self.data)]
            yield q, code, at + q <= end


def longest_gram(letters: np.ndarray) -> np.ndarray:
    """Bound on the grams of a word: two of them fit into it and its marks side by side."""
    return np.minimum(LONGEST, (letters + 2) // 2)


def gram_dictionary(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, counts) of the frequent grams of a table with ``word``.

    The words hold at most (LONGEST - 1) grams for each letter and mark, so the least
    count is set where no more than ``DICTIONARY`` grams can be above it.
    """
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    least = max(FREQUENT, -(-(LONGEST - 1) * places // DICTIONARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, None, RUN_WORDS * 16):
            marked = Marked.of(table.column("word").to_pylist())
            for _, code, fits in marked.codes():
                # A code of q letters has q bytes and none of them is zero, so q needs no place.
                known, n = np.unique(code[fits], return_counts=True)
                whole = pa.table({"gram": pa.array(known.view(np.int64)), "n": pa.array(n)})
                yield from whole.to_batches(max_chunksize=1 << 15)

    counted = words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > least).toArrow()  # at most DICTIONARY rows
    codes = rows.column("gram").to_numpy().view(_U64)
    order = np.argsort(codes)
    return codes[order], rows.column("n").to_numpy()[order]


def decompose(marked: Marked, bound: np.ndarray, grams: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, code, count) of the gram at each place; ``bound`` holds each word's longest gram.

    A place too near the end for a gram has 0 letters.  Counts of pruned grams are 0.
    """
    known, counts = grams
    size = len(marked.data)
    letters, gram, count = np.zeros(size, np.int64), np.zeros(size, _U64), np.zeros(size, np.int64)
    bound = np.repeat(bound, marked.length)
    open_ = np.ones(size, bool)
    for q, code, fits in marked.codes():
        open_ &= fits & (q <= bound)
        here = np.flatnonzero(open_)
        letters[here], gram[here] = q, code[here]
        at = np.searchsorted(known, code[here])
        found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == code[here]) if len(known) else np.zeros(len(here), bool)
        count[here] = np.where(found, counts[np.minimum(at, len(known) - 1)] if len(known) else 0, 0)
        open_[here[~found]] = False
    return letters, gram, count


def rarest_two(marked: Marked, letters: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two grams of each word that do not overlap, with the smallest sum of counts."""
    words, longest = len(marked.first) - 1, int(marked.length.max(initial=0))
    one, two = np.zeros(words, np.int64), np.zeros(words, np.int64)
    if longest > 64:  # a few very long words: their first and last gram will do
        long = marked.length > 64
        one[long], two[long] = marked.first[:-1][long], marked.first[1:][long] - LONGEST
        # The last place whose gram lies behind the first one in any case.
        longest = 64
    far = np.int64(1) << 60
    # Words in a grid, by place from their start.
    rows = np.flatnonzero(marked.length <= 64)
    at = marked.first[:-1][rows][:, None] + np.arange(longest)[None, :]
    inside = np.arange(longest)[None, :] < marked.length[rows][:, None]
    at = np.where(inside, at, 0)
    there = inside & (letters[at] > 0)
    cost = np.where(there, count[at], far)
    # Best gram from each place on, the first of equal ones.
    best = np.minimum.accumulate(cost[:, ::-1], axis=1)[:, ::-1]
    behind = np.minimum(np.arange(longest)[None, :] + letters[at], longest - 1)
    ended = np.arange(longest)[None, :] + letters[at] >= longest
    rest = np.where(ended | ~there, far, np.take_along_axis(best, behind, axis=1))
    total = np.minimum(cost + rest, far)
    left = total.argmin(axis=1)
    pick = np.arange(len(rows))
    from_ = behind[pick, left]
    later = np.arange(longest)[None, :] >= from_[:, None]
    right = np.where(later, cost, far).argmin(axis=1)
    one[rows], two[rows] = marked.first[:-1][rows] + left, marked.first[:-1][rows] + right
    return one, two


def _key(gram: np.ndarray, place: np.ndarray, length: np.ndarray, bound: np.ndarray, part: np.ndarray) -> np.ndarray:
    where = ((place.astype(_U64) * _U64(1 << 30) + length.astype(_U64)) * _U64(16) + bound.astype(_U64)) * _U64(1 << 20)
    return mixed(mixed(gram) ^ mixed(where + part.astype(_U64)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of different words one edit apart, in both directions.

    ``words`` has unique words and their counts ``n``.  Words may be of any length from four
    letters on.
    """
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(gram_dictionary(words))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, None, RUN_WORDS * 24):
            yield from _entries(table.combine_chunks(), held.value)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(batches)
        pa.default_memory_pool().release_unused()

    entries = words.select("word", "n").mapInArrow(spread, "key bigint, asks tinyint, word string, n bigint")
    merged = entries.repartition("key").sortWithinPartitions("key", "asks")
    found = merged.mapInArrow(merge, "word string, n bigint, near string, near_n bigint")
    return found.dropDuplicates(["word", "near"])


def _entries(table: pa.Table, grams: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings (asks 0) and look-ups (1: as long, 2: one letter more) of some words."""
    marked = Marked.of(table.column("word").to_pylist())
    length = marked.length
    letters = length - 2
    word = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(marked.data)) - np.repeat(marked.first[:-1], length)

    def batches(row: np.ndarray, key: np.ndarray, asks: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(row), 1 << 15):
            take = pa.array(row[a : a + (1 << 15)])
            kind = pa.array(np.full(len(take), asks, np.int8))
            columns = [pa.array(key[a : a + (1 << 15)].view(np.int64)), kind, table.column("word").take(take), table.column("n").take(take)]
            yield from pa.table(columns, ["key", "asks", "word", "n"]).combine_chunks().to_batches()

    own = longest_gram(letters)
    for bound, which in ((own, None), (longest_gram(letters - 1), longest_gram(letters - 1) != own)):
        size, gram, count = decompose(marked, bound, grams)
        some = size > 0
        if which is not None:
            some &= np.repeat(which, length)
        spot = np.flatnonzero(some)
        w = word[spot]
        parts = _parts(count[spot])
        # A posting of a frequent gram stands in each of its partitions.
        copies = np.repeat(np.arange(len(spot)), parts)
        part = np.arange(len(copies)) - np.repeat(np.cumsum(parts) - parts, parts)
        spot, w = spot[copies], w[copies]
        yield from batches(w, _key(gram[spot], place[spot], length[w], bound[w], part), 0)
        if which is not None:
            continue
        for spot in rarest_two(marked, size, count):
            spot = spot[size[spot] > 0]
            w = word[spot]
            part = mixed(w.astype(_U64) + _U64(1)) % _parts(count[spot]).astype(_U64)
            for shift, more, asks in ((0, 0, 1), (0, 1, 2), (1, 1, 2)):
                yield from batches(w, _key(gram[spot], place[spot] + shift, length[w] + more, bound[w], part), asks)


def _parts(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + count // LIST_ROWS, 1 << 19)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified pairs of runs of whole keys; a key has about ``LIST_ROWS`` postings at most."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if size + len(keys) < RUN_WORDS:
            held.append(batch)
            size += len(keys)
            continue
        last = int(np.searchsorted(np.concatenate([[0], np.cumsum(np.diff(keys) != 0)]), np.count_nonzero(np.diff(keys))))
        if last:
            yield from _verified(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held, size = [batch.slice(last)], len(keys) - last
        elif held and held[-1].column("key")[-1].as_py() != int(keys[0]):
            yield from _verified(pa.Table.from_batches(held))
            held, size = [batch], len(keys)
        else:
            held.append(batch)
            size += len(keys)
    if held:
        yield from _verified(pa.Table.from_batches(held))


#: Letters of a row of the grids in which words are compared.
_WIDTH = 32


def _verified(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    key, asks = table.column("key").to_numpy(), table.column("asks").to_numpy()
    coded = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    size = np.array([len(w) for w in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), np.uint8)
    first = np.cumsum(size) - size
    mask = np.bitwise_or.reduceat(_U64(1) << (flat & 63).astype(_U64), first) if len(flat) else np.zeros(0, _U64)
    column = np.arange(_WIDTH)[None, :]
    inside = column < size[:, None]
    head = np.where(inside, flat[np.minimum(first[:, None] + column, len(flat) - 1)], 0).astype(np.uint8)
    tail = np.where(inside, flat[np.maximum((first + size)[:, None] - 1 - column, 0)], 0).astype(np.uint8)

    group = np.concatenate([[0], np.cumsum(np.diff(key) != 0)])
    begin = np.searchsorted(group, np.arange(group[-1] + 1))
    many = np.bincount(group[asks == 0], minlength=group[-1] + 1)  # postings stand first in their key
    ask = np.flatnonzero(asks)
    pairs = np.concatenate([[0], np.cumsum(many[group[ask]])])
    k = 0
    while k < len(ask):
        upto = max(k + 1, int(np.searchsorted(pairs, pairs[k] + PAIRS, "right")) - 1)
        rows = ask[k:upto]
        lists = many[group[rows]]
        i = np.repeat(rows, lists)
        j = np.arange(len(i)) - np.repeat(np.cumsum(lists) - lists, lists) + np.repeat(begin[group[rows]], lists)
        k = upto
        near = (size[j] - size[i] == asks[i] - 1) & (np.bitwise_count(mask[i] ^ mask[j]) <= 2)
        i, j = i[near], j[near]
        wide = size[j] > _WIDTH
        hit = np.zeros(len(i), bool)
        hit[wide] = [_one_edit(coded[a], coded[b]) for a, b in zip(i[wide].tolist(), j[wide].tolist(), strict=True)]
        i_, j_ = i[~wide], j[~wide]
        same, other = _common(head[i_], head[j_]), _common(tail[i_], tail[j_])
        shorter, longer = size[i_], size[j_]
        # Of two words of one length, the look-up of the smaller one counts.
        at = np.minimum(same, _WIDTH - 1)
        ordered = head[i_, at] < head[j_, at]
        hit[~wide] = np.where(longer > shorter, same + other >= shorter, (same + other == shorter - 1) & ordered)
        i, j = i[hit], j[hit]
        if len(i):
            left, right = table.take(pa.array(np.concatenate([i, j]))), table.take(pa.array(np.concatenate([j, i])))
            out = [left.column("word"), left.column("n"), right.column("word"), right.column("n")]
            yield from pa.table(out, ["word", "n", "near", "near_n"]).combine_chunks().to_batches(max_chunksize=1 << 14)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDTH)


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b``, as long as ``a`` and greater or one letter longer, is one edit away."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return k < len(a) and a[k] < b[k] and a[k + 1 :] == b[k + 1 :]
    return a[k:] == b[k + 1 :]


# --- forms ---


def forms(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of unique words with counts ``n``.

    A word's form is the word one edit away with the largest count (of equal ones the first
    in code-point order) if that is ``ratio`` times its own or more, else null.  The root is
    the last of the forms that follow from the word, itself if it has none.  An empty table
    gives no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    order = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), order.alias("first"))
    joined = words.join(near, "word", "left").withColumn("first_n", -F.col("first.less"))
    wins = F.col("first_n") >= ratio * F.col("n")
    chosen = materialize(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(wins, F.col("first.near")).alias("form"),
            F.when(wins, F.col("first_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _followed(chosen.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return chosen.join(roots, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )


def _followed(links: DataFrame) -> DataFrame:
    """Each word with the last one its links lead to; counts grow, so there are no circles.

    Every round doubles the length of the ways that are followed.
    """
    links = materialize(links, "links")
    while True:
        further = links.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        moved = links.join(further, "to", "left")
        stepped = materialize(moved.select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "links")
        links = stepped.select("word", "to")
        if not stepped.where("moved").limit(1).count():
            return links
