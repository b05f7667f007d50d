"""Readers for job logs: block status, record status, timings and growth logs.

All rows keep ``(file, line_no)`` so that "the last line wins" has one meaning
when a job left several logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.sources.delimited import Paths, read_lines

# Line patterns.
BLOCK_LINE = r"^(S|E\S+)\t(\d+)\s*$"
TIMING_LINE = r"\[\d*\] \[TIMING\] Slave (\d+), Worker (\d+) (.*) at (\d\S*)\."
MOLECULE_LINE = r"Molecule: (ZINC[0-9]*)"
GROWTH_ERROR = "ERROR:  Could not complete growth."
TIMING_BEGIN, TIMING_DONE = "beginning search", "done with search"


def read_logs(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """Lines of every file named ``log`` below the given folders."""
    return read_lines(spark, paths, glob="log", recursive=True, **kw)


def parse_block_log(lines: DataFrame, *, mode: str = "fail") -> DataFrame:
    """(file, line_no, status, code, block_id) with status S or E.

    Comments and empty lines are skipped.  A malformed line fails the job, is
    kept with a ``_corrupt`` text (``mode='permissive'``) or is dropped
    (``mode='drop'``).
    """
    token = F.regexp_extract("value", BLOCK_LINE, 1)
    kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if mode == "fail":
        bad = F.raise_error(F.concat(F.lit("malformed log line: "), "value")).cast("string")
        token = F.when(F.col("value").rlike(BLOCK_LINE), token).otherwise(bad)
    elif mode == "drop":
        kept = kept.where(F.col("value").rlike(BLOCK_LINE))
    parsed = kept.select(
        "file",
        "line_no",
        F.nullif(F.substring(token, 1, 1), F.lit("")).alias("status"),
        F.nullif(F.substring(token, 2, 2**31 - 1), F.lit("")).alias("code"),
        F.nullif(F.regexp_extract("value", BLOCK_LINE, 2), F.lit("")).cast("long").alias("block_id"),
        F.when(~F.col("value").rlike(BLOCK_LINE), F.col("value")).alias("_corrupt"),
    )
    return parsed if mode == "permissive" else parsed.drop("_corrupt")


def parse_key_log(lines: DataFrame) -> DataFrame:
    """(file, line_no, status, key): S or E lines, key from the sixth character on."""
    status = F.substring("value", 1, 1)
    return lines.where(status.isin("S", "E")).select(
        "file", "line_no", status.alias("status"), F.substring("value", 6, 2**31 - 1).alias("key")
    )


def parse_timing_log(lines: DataFrame) -> DataFrame:
    """(pos, slave, worker, event, t) of the timing lines."""

    def part(i: int) -> Column:
        return F.regexp_extract("value", TIMING_LINE, i)

    return lines.where(F.col("value").rlike(TIMING_LINE)).select(
        "pos",
        part(1).cast("int").alias("slave"),
        part(2).cast("int").alias("worker"),
        part(3).alias("event"),
        part(4).cast("double").alias("t"),
    )


def parse_growth_log(lines: DataFrame) -> DataFrame:
    """(pos, molecule, failed): molecule named on the line, and whether it is an error line."""
    return lines.select(
        "pos",
        F.nullif(F.regexp_extract("value", MOLECULE_LINE, 1), F.lit("")).alias("molecule"),
        F.col("value").contains(GROWTH_ERROR).alias("failed"),
    )
