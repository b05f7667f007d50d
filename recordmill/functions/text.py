"""Scalar functions over records, headers and identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_id(header: Column | str) -> Column:
    """First blank-delimited word after the leading ``>``; NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(header), r"^>?+\s*(\S+)", 1), F.lit(""))


def letter_count(body: Column | str) -> Column:
    """Number of ASCII letters; -1 for a record that has no body line (NULL body)."""
    return F.coalesce(F.length(F.regexp_replace(_col(body), "[^A-Za-z]", "")), F.lit(-1))


def residue_count(body: Column | str) -> Column:
    """Characters other than newline, carriage return, tab and blank."""
    return F.length(F.translate(_col(body), "\n\r\t ", ""))


def nonspace_count(body: Column | str) -> Column:
    """Characters other than the six C-locale white-space characters."""
    return F.length(F.translate(_col(body), " \t\n\x0b\f\r", ""))


def byte_length(raw: Column | str) -> Column:
    return F.octet_length(_col(raw)).cast("long")


def letters(body: Column | str) -> Column:
    """The body reduced to upper-case ASCII letters: the searchable sequence."""
    return F.upper(F.regexp_replace(_col(body), "[^A-Za-z]", ""))


def clip_id(s: Column | str, force: bool = False) -> Column:
    """Identifier inside a bar-separated sequence name.

    ``gi|5|ref|x`` gives ``5``; otherwise the text before the first bar.  With
    ``force``, a name without a bar gives the empty string.
    """
    s = _col(s)
    head = F.split_part(s, F.lit("|"), F.lit(1))
    gi = F.split_part(F.substring(s, 4, 2**31 - 1), F.lit("|"), F.lit(1))
    out = F.when((F.length(s) >= 4) & s.startswith("gi|"), gi).otherwise(head)
    if force:
        out = F.when(~s.contains("|"), F.lit("")).otherwise(out)
    return F.when(s.isNotNull(), out)


def clip_organism(s: Column | str) -> Column:
    """Text between the first ``[`` and the next ``]``; empty when absent."""
    return F.regexp_extract(_col(s), r"\[([^\]]*)\]", 1)


def query_name(iteration_def: Column | str, document_def: Column | str) -> Column:
    """Clipped iteration definition, else the first word of the document definition."""
    fallback = F.nullif(F.regexp_extract(_col(document_def), r"(\S+)", 1), F.lit(""))
    return F.coalesce(clip_id(iteration_def), fallback)


def gi_token(raw: Column | str) -> Column:
    """Text between the first and second bar; the first word when there is no bar."""
    raw = _col(raw)
    token = F.split_part(raw, F.lit("|"), F.lit(2))
    return F.when(raw.contains("|"), token).otherwise(record_id(raw))


def recovery_key(raw: Column | str) -> Column:
    """First 32 bytes of a multi-line record, else the whole record, as bytes."""
    data = F.encode(_col(raw), "UTF-8")
    return F.when(_col(raw).contains("\n"), F.substring(data, 1, 32)).otherwise(data)


def recovery_key_flat(raw: Column | str) -> Column:
    """First 32 bytes with line breaks turned into blanks, as bytes."""
    return F.substring(F.encode(F.translate(_col(raw), "\n\r", "  "), "UTF-8"), 1, 32)


def char_count(s: Column | str, ch: str) -> Column:
    s = _col(s)
    return F.length(s) - F.length(F.translate(s, ch, ""))


def relative_height(count: Column | str, highest: Column | str) -> Column:
    return F.round(_col(count) / _col(highest), 6)


def join_lines(s: Column | str) -> Column:
    """Text of an element with its physical line breaks removed; blank text is dropped."""
    flat = F.regexp_replace(_col(s), r"\n", "")
    return F.when(F.trim(flat) == "", F.lit(None)).otherwise(flat)


def deflines(header: Column | str) -> Column:
    """Non-redundant header split into an array of (gi, db, acc, title, organism)."""

    def one(d: Column) -> Column:
        seqid = F.regexp_extract(d, r"^>?(\S*)", 1)
        return F.struct(
            F.when(seqid.startswith("gi|"), F.split_part(seqid, F.lit("|"), F.lit(2))).alias("gi"),
            F.split_part(seqid, F.lit("|"), F.when(seqid.startswith("gi|"), 3).otherwise(1)).alias("db"),
            F.split_part(seqid, F.lit("|"), F.when(seqid.startswith("gi|"), 4).otherwise(2)).alias("acc"),
            F.regexp_extract(d, r"^\S*\s*(.*)$", 1).alias("title"),
            clip_organism(d).alias("organism"),
        )

    return F.transform(F.split(_col(header), "\x01"), one)


def percent_done(done: Column | str, total: Column | str) -> Column:
    """Whole percent, rounded down."""
    return F.floor(F.lit(100) * _col(done) / _col(total)).cast("long")


def text_runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of a non-null text column, or one longer row."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
