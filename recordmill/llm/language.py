"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of an n-gram binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a text bundles (adds) the
vectors of its n-grams, and a language bundles its training texts.  A text gets the language
whose prototype has the largest cosine.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recordmill.llm.textarrays import WINDOW, gathered, map_tables, prepare
from recordmill.session import materialize

DIMENSIONS = 1024
#: Letters of an n-gram; a gap between words counts as a letter.
GRAM = 3
UNKNOWN = "und"
#: Texts bundled in one product, and n-grams in one part of it.
_ROWS = 64
_GRAMS = 2048


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The same random vector for a letter in every task; code 0 is the gap."""
    draw = np.random.default_rng([20, code]).integers(0, 2, dimensions, dtype=np.int8)
    return draw * np.int8(2) - np.int8(1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, alphabet): one row per n-gram; n-grams are numbers in base len(alphabet)."""
    lowered = [f"\n{t.lower()}\n" if t else "\n\n" for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    length = np.array([len(t) for t in lowered], np.int64)
    begin = np.cumsum(length) - length
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character behind a letter is the gap
    keep[begin] = True
    owner = np.repeat(np.arange(len(texts)), length)[keep]
    alphabet, symbol = np.unique(np.where(letter, code, 0)[keep], return_inverse=True)
    base, n = len(alphabet), len(symbol) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), alphabet
    gram = np.zeros(n, np.int64)
    for k in range(GRAM):
        gram = gram * base + symbol[k : k + n]
    inside = owner[:n] == owner[GRAM - 1 :]
    return owner[:n][inside], gram[inside], alphabet


def gram_vectors(gram: np.ndarray, alphabet: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams: the product of rotated letter vectors."""
    table = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    out = np.ones((len(gram), dimensions), np.int8)
    for k in range(GRAM):
        symbol = gram // len(alphabet) ** (GRAM - 1 - k) % len(alphabet)
        out *= np.roll(table, GRAM - 1 - k, axis=1)[symbol]
    return out


def learn(rows: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, prototype): each text adds its n-gram vectors, scaled to one text, to its language.

    Rows with a null language or no letter teach nothing.  Tasks bundle first; what is
    shuffled is one vector per language and task.
    """
    chosen = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table in gathered(batches, "text", WINDOW):
            owner, gram, alphabet = grams(table.column("text").to_pylist())
            if not len(owner):
                continue
            known, which = np.unique(np.array(table.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            unique, at = np.unique(gram, return_inverse=True)
            weight = 1.0 / np.bincount(owner, minlength=table.num_rows).clip(1)
            cell = which[owner] * len(unique) + at
            count = np.bincount(cell, weight[owner], len(known) * len(unique)).reshape(len(known), -1)
            for a in range(0, len(unique), _GRAMS):
                vectors = gram_vectors(unique[a : a + _GRAMS], alphabet, dimensions).astype(np.float64)
                part = count[:, a : a + _GRAMS] @ vectors
                for name, vector in zip(known.tolist(), part, strict=True):
                    sums[name] = sums.get(name, 0.0) + vector
        if sums:
            yield pa.record_batch(
                {"lang": pa.array(list(sums), pa.string()), "part": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
            )

    parts = chosen.mapInArrow(run, "lang string, part array<double>")
    cells = parts.select("lang", F.posexplode("part").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "x")))
    return cells.groupBy("lang").agg(F.transform(ordered, lambda s: s["x"]).alias("prototype")).where(
        F.exists("prototype", lambda x: x != 0)
    )


def identify(docs: DataFrame, prototypes: DataFrame, *, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with __lang (a learned language or ``und``) and __score (its cosine, 0 to 1).

    Null texts, texts without a letter, and all texts where nothing was learned are ``und``
    with score 0.  Equal cosines go to the language first in the alphabet.  Repeated rows
    are judged alike.
    """
    learned = sorted((r["lang"], r["prototype"]) for r in prototypes.collect())  # a vector per language
    names = [name for name, _ in learned]
    matrix = np.array([v for _, v in learned], np.float64).reshape(len(names), dimensions)
    matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True).clip(1e-300)).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def work(table: pa.Table) -> pa.Table:
        names, matrix = held.value
        lang, score = judge(table.column(text).to_pylist(), names, matrix)
        return table.append_column("__lang", pa.array(lang, pa.string())).append_column("__score", pa.array(score))

    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema]).add("__lang", "string").add("__score", "double")
    return map_tables(docs, work, schema, text)


def judge(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names:
        return lang, score
    for a in range(0, len(texts), _ROWS):
        block = texts[a : a + _ROWS]
        owner, gram, alphabet = grams(block)
        unique, at = np.unique(gram, return_inverse=True)
        bundle = np.zeros((len(block), matrix.shape[1]), np.float32)
        for b in range(0, len(unique), _GRAMS):
            inside = (at >= b) & (at < b + _GRAMS)
            size = min(_GRAMS, len(unique) - b)
            cell = owner[inside] * size + (at[inside] - b)
            count = np.bincount(cell, minlength=len(block) * size).astype(np.float32).reshape(len(block), size)
            bundle += count @ gram_vectors(unique[b : b + size], alphabet, matrix.shape[1]).astype(np.float32)
        norm = np.linalg.norm(bundle, axis=1)
        cosine = bundle @ matrix.T / np.maximum(norm, 1e-30)[:, None]
        best = cosine.argmax(axis=1)
        has = np.bincount(owner, minlength=len(block)) > 0
        for k in np.flatnonzero(has):
            lang[a + k] = names[best[k]]
            score[a + k] = min(1.0, max(0.0, float(cosine[k, best[k]])))
    return lang, score


def held_out(doc_id: str) -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, as they came, that have a language; the others are rejected.

    Where nothing can be learned, every text with a letter is accepted.
    """
    prototypes = materialize(learn(docs.where(~held_out(doc_id)), text=text, lang=lang), "prototypes")
    if not prototypes.limit(1).count():
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, prototypes, text=text).where(F.col("__lang") != UNKNOWN).select(*docs.columns)
