"""Residue-level functions: translation, strands, ranges, substitution scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Residue per codon, bases in the order T, C, A, G.
BASES = "TCAG"
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    15: "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
# M marks a codon that may start a reading frame, same base order.
START_CODONS = {
    1: "---M---------------M---------------M----------------------------",
    2: "--------------------------------MMMM---------------M------------",
    3: "----------------------------------MM----------------------------",
    4: "--MM---------------M------------MMMM---------------M------------",
    5: "---M----------------------------MMMM---------------M------------",
    6: "-----------------------------------M----------------------------",
    9: "-----------------------------------M---------------M------------",
    10: "-----------------------------------M----------------------------",
    11: "---M---------------M------------MMMM---------------M------------",
    12: "-------------------M---------------M----------------------------",
    13: "---M------------------------------MM---------------M------------",
    14: "-----------------------------------M----------------------------",
    15: "-----------------------------------M----------------------------",
    16: "-----------------------------------M----------------------------",
    21: "-----------------------------------M---------------M------------",
    22: "-----------------------------------M----------------------------",
    23: "--------------------------------M--M---------------M------------",
}


def genetic_code_table(spark: SparkSession) -> DataFrame:
    """(code_id, codon, aa, is_start): one row per code and codon."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    rows = [
        (code, codon, aa, start == "M")
        for code, residues in GENETIC_CODES.items()
        for codon, aa, start in zip(codons, residues, START_CODONS[code])
    ]
    return spark.createDataFrame(rows, "code_id INT, codon STRING, aa STRING, is_start BOOLEAN")


def translate_codons(seq: Column | str, code_id: int = 1, frame: int = 0) -> Column:
    """Translate a nucleotide string; a codon with another symbol gives ``X``.

    Codons come from one regular-expression pass, so the cost is linear in the
    length (repeated ``substring`` on a long string is quadratic).
    """
    seq = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    seq = F.translate(seq, "U", "T")
    seq = F.substring(seq, frame + 1, 2**31 - 1)

    def base(codon: Column, i: int) -> Column:
        return F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1

    def residue(codon: Column) -> Column:
        at = base(codon, 1) * 16 + base(codon, 2) * 4 + base(codon, 3)
        known = codon.rlike("^[TCAG]{3}$")
        return F.when(known, F.substr(F.lit(GENETIC_CODES[code_id]), at + 1, F.lit(1))).otherwise(F.lit("X"))

    codons = F.regexp_extract_all(seq, F.lit("(?s)(.{3})"), F.lit(1))
    return F.array_join(F.transform(codons, residue), "")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, "ACGTacgt", "TGCAtgca"))


def subsequence(seq: Column | str, start: int = 0, stop: int = 0) -> Column:
    """Residues start..stop, 1-based and inclusive; 0 means the respective end."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    first = max(start, 1)
    length = (stop - first + 1) if stop else 2**31 - 1
    return F.substring(seq, first, max(length, 0))


def wrap_lines(seq: Column | str, width: int = 80) -> Column:
    """Break a sequence into lines of ``width`` residues."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    lines = F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))
    return F.array_join(lines, "\n")


def substitution_score(a: Column, b: Column, scores: Mapping[tuple[str, str], int], default: int | None = None) -> Column:
    """Score of a residue pair from a substitution table (an alphabet squared, so small)."""
    items: list[Column] = []
    for (x, y), value in scores.items():
        items += [F.lit(x + y), F.lit(int(value))]
    found = F.try_element_at(F.create_map(*items), F.concat(a, b))
    return found if default is None else F.coalesce(found, F.lit(default))


def allowed_position(start: Column, word: int, ranges: Column) -> Column:
    """True when a word starting at ``start`` lies inside one of the allowed ranges.

    ``ranges`` is an array of (left, right) structs, 0-based, right exclusive.
    """
    return F.exists(ranges, lambda r: (start >= r["left"]) & (start + word <= r["right"]))
