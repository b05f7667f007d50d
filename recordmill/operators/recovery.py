"""What a stopped job finished, failed or never reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.plans.ordered import ordinal

SUCCESS, FAILED, RESUME = "success", "failed", "resume"


def last_status(log: DataFrame) -> DataFrame:
    """(block_id, status): the last line of a block wins, in (file, line) order."""
    return log.groupBy("block_id").agg(F.max_by("status", F.struct("file", "line_no")).alias("status"))


def classify_blocks(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Add ``outcome``: S is success, E is failed, a block without a line is to be resumed."""
    status = last_status(log)
    outcome = F.when(F.col("status") == "S", SUCCESS).when(F.col("status") == "E", FAILED).otherwise(RESUME)
    return blocks.join(status, "block_id", "left").select(*blocks.columns, outcome.alias("outcome"))


def classify_records(records: DataFrame, order: str, key: str, log: DataFrame) -> DataFrame:
    """Add ``outcome`` where each logged key settles exactly one record.

    Of the records sharing a key, in input order, the first ``S`` count are
    successes, the next ``E`` count failures and the rest are to be resumed.
    """
    logged = log.groupBy(F.col("key").alias(key)).agg(
        F.count_if(F.col("status") == "S").alias("done"), F.count_if(F.col("status") == "E").alias("lost")
    )
    placed = ordinal(records, order, "nth", within=[key])
    done, lost = F.coalesce("done", F.lit(0)), F.coalesce("lost", F.lit(0))
    outcome = F.when(F.col("nth") < done, SUCCESS).when(F.col("nth") < done + lost, FAILED).otherwise(RESUME)
    return placed.join(logged, key, "left").select(*records.columns, outcome.alias("outcome"))


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count("*").alias("records"))


def split_outcomes(classified: DataFrame) -> dict[str, DataFrame]:
    """The three outputs.  Materialize ``classified`` first to classify only once."""
    return {o: classified.where(F.col("outcome") == o) for o in (SUCCESS, FAILED, RESUME)}
