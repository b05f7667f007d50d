"""Personal data: fixed patterns, and more spans from a semi-Markov conditional random field.

The field scores whole candidate segments (their digits, separators, checksum, neighbours),
not single tokens, and dynamic programming over segments of at most ``MAX_TOKENS`` tokens
chooses boundaries and kinds of a stretch of text jointly.  It learns from the pattern spans
of a bounded sample of stretches, some of them rewritten to forms that the patterns do not
know.  A candidate holds a digit or an at sign, so text without one needs no decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from recordmill.llm.samples import smallest_hashes
from recordmill.llm.textarrays import map_tables, prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end (code points)

#: Tokens of a candidate segment.
MAX_TOKENS = 16
#: Stretches the field learns from.
SAMPLE = 1500
#: Characters kept on both sides of a trigger.
MARGIN = 24
#: Tokens whose segments are scored at once.
BLOCK = 1024
#: A span is added if it is better than leaving it out by this much (log odds).
MARGIN_SCORE = 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
#: What addresses, names and numbers are made of; no stretch ends inside a run of these.
_RUN = re.compile(r"[\w.%+-]+")


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping in each kind, in time linear in the text."""
    spans: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:  # the part before an at sign reaches as far back as its characters go
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1)
        if begin < at and domain:
            last = domain.end()
            spans.append((0, begin, last))
        at = text.find("@", at + 1)
    for chain in _CHAIN.finditer(text):
        if chain.group().count(".") >= 3:
            parts = list(_PART.finditer(text, chain.start(), chain.end()))
            for k in range(0, len(parts) - 3, 4):
                if all(len(p.group().lstrip("0")) <= 3 and int(p.group()) <= 255 for p in parts[k : k + 4]):
                    spans.append((1, parts[k].start(), parts[k + 3].end()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 13:
            digits = _digits(found.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_digits(found.group())) <= 15:
                spans.append((3, *found.span()))
    return spans


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of a text around triggers, disjoint; neither end cuts a run of ``_RUN``.

    A part is as long as its chain of triggers asks for; the time is linear in the text.
    """
    begin = end = -1
    for found in _TRIGGER.finditer(text):
        low, high = found.start() - MARGIN, found.end() + MARGIN
        if begin < 0 or low > end:
            if begin >= 0:
                yield begin, end
            begin, low = max(low, 0), max(end, 0)
            if _RUN.match(text, begin):
                while begin > low and _RUN.match(text, begin - 1, begin):
                    begin -= 1
        if high > end:
            run = _RUN.match(text, high) if high < len(text) and _RUN.match(text, high - 1, high) else None
            end = run.end() if run else min(high, len(text))
    if begin >= 0:
        yield begin, end


_NAMES = (
    "one at_sign dotted_domain short_domain local quad checksum digits_9_12 digits_13_15 digits_16_19 digits_few "
    "digits_many plus bracket only_digits digits_and_separators letters other_signs bracketed_at left_word right_word "
    "left_sign right_sign tokens_2_6 tokens_7_up groups_3 space_inside"
).split()
_WIDTH = len(_NAMES)
_EMAIL = re.compile(r"([A-Za-z0-9._%+-]+) ?(@|[\[(]at[\])]) ?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def _features(part: str, tokens: int, before: str, behind: str) -> list[int]:
    """Numbers of the whole-span features that hold."""
    digits = _digits(part)
    n = len(digits)
    letters = any(c.isalpha() for c in part)
    plain = not letters and all(c in "0123456789 -().+" for c in part)
    email = _EMAIL.fullmatch(part)
    on = [0]
    on += [1] * ("@" in part)
    if email:
        on += [2 if len(email[3]) > 6 else 3, 4]
    quad = _QUAD.fullmatch(part)
    if quad and all(int(x) <= 255 for x in part.split(".")):
        on.append(5)
    if 13 <= n <= 19 and plain and luhn(digits):
        on.append(6)
    on.append(7 if 9 <= n <= 12 else 8 if 13 <= n <= 15 else 9 if 16 <= n <= 19 else 10 if n < 9 else 11)
    on += [12] * part.startswith("+") + [13] * ("(" in part and ")" in part)
    on += [14] * (n == len(part)) + [15] * (plain and n < len(part)) + [16] * letters
    on += [17] * any(not c.isalnum() and c not in " -().+@_%" for c in part)
    on += [18] * bool(email and email[2] != "@")
    on += [19] * (before.isalnum()) + [20] * (behind.isalnum())
    on += [21] * (bool(before) and not before.isalnum() and not before.isspace())
    on += [22] * (bool(behind) and not behind.isalnum() and not behind.isspace())
    on += [23] * (2 <= tokens <= 6) + [24] * (tokens >= 7)
    on += [25] * (len(re.findall(r"[0-9]+", part)) >= 3) + [26] * (" " in part)
    return on


def candidates(text: str, bounds: list[int] | None = None, starts: int | None = None) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """(token bounds, segments): segments are (first token, token behind, features).

    With ``bounds`` of some tokens, the segments that begin at the first ``starts`` of them;
    the characters beside a segment are those of the text.
    """
    if bounds is None:
        bounds = [0, *(m.end() for m in _TOKEN.finditer(text))]
    tokens = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    edge = [not t.isspace() and t not in ("\"", "'", ",", ";", ":", "|", "=") for t in tokens]
    trigger = [bool(_TRIGGER.search(t)) or t == "at" for t in tokens]
    segments = []
    for i in range(len(tokens) if starts is None else starts):
        if not edge[i]:
            continue
        holds = False
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            if "\n" in tokens[j - 1]:
                break
            holds |= trigger[j - 1]
            if holds and edge[j - 1]:
                a, b = bounds[i], bounds[j]
                segments.append((i, j, _features(text[a:b], j - i, text[max(a - 1, 0) : a], text[b : b + 1])))
    return bounds, segments


def _blocks(text: str, begin: int, end: int) -> Iterator[tuple[list[int], int]]:
    """(token bounds, tokens that are no longer in the next block): what follows reaches on by a longest segment."""
    bounds = [begin]
    for token in _TOKEN.finditer(text, begin, end):
        bounds.append(token.end())
        if len(bounds) > BLOCK + MAX_TOKENS:
            yield bounds, BLOCK
            bounds = bounds[BLOCK:]
    yield bounds, len(bounds) - 1


def _scores(segments: list, weights: np.ndarray) -> np.ndarray:
    """segments x kinds."""
    on = np.zeros((len(segments), _WIDTH))
    for row, (_, _, features) in zip(on, segments, strict=True):
        row[features] = 1
    return on @ weights.T


def decode(text: str, weights: np.ndarray, begin: int = 0, end: int | None = None) -> list[Span]:
    """The best segmentation of a stretch: entity segments, and single tokens of score 0 between them.

    The stretch may be of any length: only the values that a longest segment reaches are held.
    """
    state: tuple = (0.0, None)  # value and last segment, which names the one before it
    offers: dict[int, tuple] = {}  # best value and segments up to a later token
    place = 0
    for bounds, starts in _blocks(text, begin, len(text) if end is None else end):
        segments = candidates(text, bounds, starts)[1]
        scores = _scores(segments, weights) - MARGIN_SCORE
        kind, value = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        s = 0
        for i in range(starts):
            offer = offers.pop(place + i, None)
            if offer and offer[0] > state[0]:
                state = offer
            while s < len(segments) and segments[s][0] == i:
                j = segments[s][1]
                reached, known = state[0] + value[s], offers.get(place + j)
                if value[s] > 0 and (known is None or reached > known[0]):
                    offers[place + j] = reached, ((kind[s], bounds[i], bounds[j]), state[1])
                s += 1
        place += starts
    offer = offers.pop(place, None)
    if offer and offer[0] > state[0]:
        state = offer
    spans, last = [], state[1]
    while last:
        span, last = last
        spans.append(span)
    return spans[::-1]


def train(sample: list[str], rounds: int = 4, step: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (kind x feature) that maximise the likelihood of the pattern spans of the sample.

    Gradient ascent; the expectation of each segment comes from forward and backward sums
    over all segmentations of a stretch.
    """
    cases = []
    for text in sample:
        for shown, gold in _forms(text):
            bounds, segments = candidates(shown)
            place = {b: k for k, b in enumerate(bounds)}
            wanted = {(place.get(a), place.get(b)): kind for kind, a, b in gold}
            target = np.zeros((len(segments), len(KINDS)))
            for s, (i, j, _) in enumerate(segments):
                if (i, j) in wanted:
                    target[s, wanted[i, j]] = 1
            if segments and target.sum() == len(wanted):  # else a span has no candidate of its bounds
                on = np.zeros((len(segments), _WIDTH))
                for row, (_, _, features) in zip(on, segments, strict=True):
                    row[features] = 1
                cases.append((len(bounds) - 1, [(i, j) for i, j, _ in segments], on, target))
    weights = np.zeros((len(KINDS), _WIDTH))
    weights[:, 0] = -2.0
    squares = np.full_like(weights, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(cases)):
            n, ends, on, target = cases[k]
            gradient = (target - _expected(n, ends, on @ weights.T)).T @ on - decay * weights
            squares += gradient * gradient
            weights += step * gradient / np.sqrt(squares)
    return weights


def _expected(n: int, ends: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each segment and kind over all segmentations."""
    total = np.logaddexp.reduce(scores, axis=1).tolist()
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_begin: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(ends):
        by_end[j].append(s)
        by_begin[i].append(s)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _log_sum([forward[j - 1], *(forward[ends[s][0]] + total[s] for s in by_end[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *(backward[ends[s][1]] + total[s] for s in by_begin[i])])
    outside = np.array([forward[i] + backward[j] - forward[n] for i, j in ends])
    return np.exp(scores + outside[:, None])


def _log_sum(values: list[float]) -> float:
    high = max(values)
    return high if len(values) == 1 else high + float(np.log(sum(np.exp(v - high) for v in values)))


def _forms(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The stretch with its pattern spans, and once more with each span in a form the patterns miss."""
    spans = sorted(disjoint(base_spans(text)), key=lambda s: s[1])
    yield text, spans
    shown, gold, last = "", [], 0
    for kind, a, b in spans:
        part = text[a:b]
        if kind == 0:
            part = part.replace("@", "[at]" if (a + b) % 2 else " (at) ")
        elif kind == 3 and "(" in part:
            part = part[part.index("(") :]
        shown += text[last:a]
        gold.append((kind, len(shown), len(shown) + len(part)))
        shown, last = shown + part, b
    if any(kind in (0, 3) for kind, _, _ in spans):
        yield shown + text[last:], gold


def disjoint(spans: list[Span]) -> list[Span]:
    """Without spans inside or across longer ones of any kind."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
        if all(span[2] <= a or b <= span[1] for _, a, b in kept):
            kept.append(span)
    return kept


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(pattern spans, further spans of the field that overlap none of them)."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more: list[Span] = []
    k = 0
    for begin, end in stretches(text):
        for kind, a, b in decode(text, weights, begin, end):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            free = k == len(taken) or b <= taken[k][0]
            if free and (not more or more[-1][2] <= a):
                more.append((kind, a, b))
    return base, more


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights from the ``sample`` different stretches with the smallest hashes among all of all documents.

    Of the stretches that hold pattern spans of a kind, a quarter as many are taken besides,
    so that rare kinds are taught.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0).to_pylist():
                if value:
                    found += [value[a:b] for a, b in stretches(value) if b - a <= 400]
            kinds = [{kind for kind, _, _ in base_spans(part)} for part in found]
            flags = {name: pa.array([k in own for own in kinds], pa.bool_()) for k, name in enumerate(KINDS)}
            yield pa.record_batch({"part": pa.array(found, pa.string()), **flags})

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, f"part string, {', '.join(f'{k} boolean' for k in KINDS)}")
    chosen = smallest_hashes(parts, sample, "part", also=dict.fromkeys(KINDS, sample // len(KINDS)))
    return train([r["part"] for r in chosen.collect()])


def annotate(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """``docs`` with __base and __spans: arrays of (kind, start, end), ordered by kind and start.

    __base are the pattern spans, __spans these and the field's.  Offsets are code points,
    the end exclusive.  A null text counts as empty.  Repeated rows are treated alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(table: pa.Table) -> pa.Table:
        found = [find(t or "", held.value) for t in table.column(text).to_pylist()]
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans)]
        table = table.append_column("__base", pa.array([rows(b) for b, _ in found], kind))
        return table.append_column("__spans", pa.array([rows(b + m) for b, m in found], kind))

    spans = DataType.fromDDL("array<struct<kind:int,start:bigint,end:bigint>>")
    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema]).add("__base", spans).add("__spans", spans)
    return map_tables(docs, work, schema, text)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of the first of them."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[kind].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text`` replaced; a null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def work(table: pa.Table) -> pa.Table:
        texts = [t and redact(t, sum(find(t, held.value), [])) for t in table.column(text).to_pylist()]
        return table.set_column(table.column_names.index(text), text, pa.array(texts, table.schema.field(text).type))

    return map_tables(docs, work, StructType([StructField(f.name, f.dataType) for f in docs.schema]), text)
