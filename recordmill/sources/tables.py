"""Tables and keyed files: Parquet input, formatted databases, matrices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def matrix_scores(spark: SparkSession, path: str) -> dict[tuple[str, str], int]:
    """Substitution matrix text as {(a, b): score}; an alphabet squared, so small."""
    rows = read_matrix(spark, path).collect()
    return {(r.a, r.b): r.score for r in rows}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score) from a matrix text: comments, a symbol row, one row per symbol."""
    lines = spark.read.text(path, wholetext=True).select(
        F.filter(F.split("value", "\n"), lambda l: ~l.startswith("#") & (F.trim(l) != "")).alias("l")
    )
    symbols = F.split(F.trim(F.col("l")[0]), r"\s+")
    rows = lines.select(symbols.alias("symbols"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("row"))
    cells = rows.select("symbols", F.split(F.trim("row"), r"\s+").alias("cells"))
    return cells.select(F.col("cells")[0].alias("a"), F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))), "symbols").select(
        "a", F.element_at("symbols", F.col("pos") + 1).alias("b"), F.col("col").cast("int").alias("score")
    )


def format_database(
    records: DataFrame, name: str, *, id_column: str = "id", buckets: int = 64, check_ids: bool = True
) -> None:
    """Save a searchable collection bucketed and sorted by id.

    Later id joins read the buckets in place instead of shuffling the
    collection.  Duplicate ids fail the call with ``check_ids``.
    """
    if not re.fullmatch(r"\w+(\.\w+)*", name):
        raise ValueError(f"not a table name: {name!r}")
    if check_ids and duplicate_ids(records, id_column).limit(1).count():
        raise ValueError(f"duplicate values in {id_column}")
    records.write.mode("overwrite").bucketBy(buckets, id_column).sortBy(id_column).saveAsTable(name)


def duplicate_ids(records: DataFrame, id_column: str = "id") -> DataFrame:
    return records.groupBy(id_column).agg(F.count("*").alias("copies")).where("copies > 1")
