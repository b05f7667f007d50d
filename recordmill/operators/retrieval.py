"""Boolean retrieval, lookup by id, links and collection merging."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.residues import reverse_complement, subsequence


def term_postings(records: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term): the distinct lower-case words of each record."""
    words = F.array_distinct(F.split(F.lower(text), "[^a-z]+"))
    return records.select(F.col(id_column).alias("id"), F.explode_outer(words).alias("term")).where("term <> ''")


def term_counts(records: DataFrame, id_column: str, text: str) -> DataFrame:
    """(term, records): number of records that hold each term."""
    return term_postings(records, id_column, text).groupBy("term").agg(F.count("*").alias("records"))


def has_term(text: str, term: str) -> Column:
    """Whether the term, taken literally, stands in the text between other characters than letters."""
    return F.lower(text).rlike(rf"(?<![a-z]){re.escape(term.lower())}(?![a-z])")


def both(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    return left.join(right, on, "left_semi")


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def but_not(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    return left.join(right, on, "left_anti")


def page(
    records: DataFrame, order: str | Sequence[str], offset: int, count: int, descending: Sequence[bool] | bool = False
) -> DataFrame:
    """One page of an ordered result."""
    order = [order] if isinstance(order, str) else list(order)
    down = [descending] * len(order) if isinstance(descending, bool) else list(descending)
    return records.orderBy(*order, ascending=[not d for d in down]).offset(offset).limit(count)


def fetch(
    records: DataFrame,
    ids: DataFrame | Sequence,
    id_column: str,
    sequence: str,
    *,
    start: int = 0,
    stop: int = 0,
    bottom_strand: bool = False,
) -> DataFrame:
    """(id, sequence): records by id, optionally a range and the other strand."""
    if isinstance(ids, DataFrame):
        chosen = records.join(ids.select(id_column), id_column, "left_semi")
    else:
        chosen = records.where(F.col(id_column).isin(list(ids)))
    part = subsequence(sequence, start, stop)
    return chosen.select(
        F.col(id_column).alias("id"), (reverse_complement(part) if bottom_strand else part).alias("sequence")
    )


def linked(ids: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct targets reached from a set of source ids."""
    return links.join(ids.select(source), source, "left_semi").select(target).distinct()


def link_counts(links: DataFrame, source: str) -> DataFrame:
    return links.groupBy(source).agg(F.count("*").alias("links"))


def merge_collections(first: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Union of collections; of records sharing a key the earliest collection wins."""
    tagged = first.withColumn("__rank", F.lit(0))
    for rank, other in enumerate(others, start=1):
        tagged = tagged.unionByName(other.withColumn("__rank", F.lit(rank)))
    best = tagged.groupBy(key).agg(F.min("__rank").alias("__rank"))
    return tagged.join(best, [key, "__rank"], "left_semi").drop("__rank")
