"""Search reports in XML: one or many concatenated documents per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.sources.delimited import Paths, read_delimited

# The document head and the element names of the report format.
XML_HEAD = '<?xml version="1.0"?>'

HSP_SCHEMA = """
  `Hsp_num` INT, `Hsp_bit-score` DOUBLE, `Hsp_score` DOUBLE, `Hsp_evalue` STRING,
  `Hsp_query-from` INT, `Hsp_query-to` INT, `Hsp_hit-from` INT, `Hsp_hit-to` INT,
  `Hsp_pattern-from` INT, `Hsp_pattern-to` INT, `Hsp_query-frame` INT, `Hsp_hit-frame` INT,
  `Hsp_identity` INT, `Hsp_positive` INT, `Hsp_gaps` INT, `Hsp_align-len` INT, `Hsp_density` INT,
  `Hsp_qseq` STRING, `Hsp_hseq` STRING, `Hsp_midline` STRING
"""
HIT_SCHEMA = f"""
  `Hit_num` INT, `Hit_id` STRING, `Hit_def` STRING, `Hit_accession` STRING, `Hit_len` INT,
  `Hit_hsps` STRUCT<`Hsp`: ARRAY<STRUCT<{HSP_SCHEMA}>>>
"""
STAT_SCHEMA = """
  `Statistics_db-num` INT, `Statistics_db-len` BIGINT, `Statistics_hsp-len` INT,
  `Statistics_eff-space` DOUBLE, `Statistics_kappa` DOUBLE, `Statistics_lambda` DOUBLE,
  `Statistics_entropy` DOUBLE
"""
ITERATION_SCHEMA = f"""
  `Iteration_iter-num` INT, `Iteration_query-ID` STRING, `Iteration_query-def` STRING,
  `Iteration_query-len` INT, `Iteration_hits` STRUCT<`Hit`: ARRAY<STRUCT<{HIT_SCHEMA}>>>,
  `Iteration_stat` STRUCT<`Statistics`: STRUCT<{STAT_SCHEMA}>>, `Iteration_message` STRING
"""
PARAM_SCHEMA = """
  `Parameters_matrix` STRING, `Parameters_expect` DOUBLE, `Parameters_include` DOUBLE,
  `Parameters_sc-match` INT, `Parameters_sc-mismatch` INT, `Parameters_gap-open` INT,
  `Parameters_gap-extend` INT, `Parameters_filter` STRING, `Parameters_pattern` STRING,
  `Parameters_entrez-query` STRING
"""
REPORT_SCHEMA = f"""
  `BlastOutput_program` STRING, `BlastOutput_version` STRING, `BlastOutput_reference` STRING,
  `BlastOutput_db` STRING, `BlastOutput_query-ID` STRING, `BlastOutput_query-def` STRING,
  `BlastOutput_query-len` BIGINT, `BlastOutput_query-seq` STRING,
  `BlastOutput_param` STRUCT<`Parameters`: STRUCT<{PARAM_SCHEMA}>>,
  `BlastOutput_iterations` STRUCT<`Iteration`: ARRAY<STRUCT<{ITERATION_SCHEMA}>>>,
  `BlastOutput_mbstat` STRUCT<`Statistics`: STRUCT<{STAT_SCHEMA}>>
"""


# The part of the format that hit tables need.
TAB_HIT_SCHEMA = """
  `Hit_id` STRING, `Hit_def` STRING, `Hit_hsps` STRUCT<`Hsp`: ARRAY<STRUCT<`Hsp_evalue` STRING,
    `Hsp_query-from` INT, `Hsp_query-to` INT, `Hsp_hit-from` INT, `Hsp_hit-to` INT>>>
"""
TAB_ITERATION_SCHEMA = f"""
  `Iteration_iter-num` INT, `Iteration_query-def` STRING, `Iteration_hits` STRUCT<`Hit`: ARRAY<STRUCT<{TAB_HIT_SCHEMA}>>>
"""
TAB_REPORT_SCHEMA = f"""
  `BlastOutput_query-def` STRING, `BlastOutput_iterations` STRUCT<`Iteration`: ARRAY<STRUCT<{TAB_ITERATION_SCHEMA}>>>
"""


def read_documents(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """(doc, xml): every document of every file, numbered from 1 in file order."""
    found = read_delimited(spark, paths, XML_HEAD, **kw).where(F.trim(F.translate("value", "\r\n\t", "")) != "")
    return found.select(F.col("pos").alias("doc"), F.col("value").alias("xml"))


def parse_documents(documents: DataFrame, schema: str = REPORT_SCHEMA) -> DataFrame:
    """(doc, report): typed reports; a document that does not parse fails the job.

    A smaller ``schema`` leaves out what is not needed.
    """
    options = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "true", "nullValue": ""}
    body = F.regexp_replace("xml", r"(?s)^\s*<!DOCTYPE[^>]*>", "")
    flat = F.regexp_replace(body, r"\n", "")
    return documents.select("doc", F.from_xml(flat, schema.replace("\n", " "), options).alias("report"))


def read_iterations(spark: SparkSession, paths: Paths, schema: str = ITERATION_SCHEMA) -> DataFrame:
    """Iterations as rows, straight from the file: for merged documents of any size.

    A merged document may be stored as ordered parts, each with some of its iterations and
    none of them a document of its own.  So files are cut at iterations as text, in parallel
    splits, and every iteration is parsed alone; one that does not parse or end fails the job.
    """
    pieces = spark.read.option("lineSep", "<Iteration>").text(paths)
    # A piece without an end is blank or a document's head, or else a broken iteration.
    head = (F.trim(F.translate("value", "\r\n\t", "")) == "") | F.contains("value", F.lit("<BlastOutput"))
    ended = F.contains("value", F.lit("</Iteration>"))
    inside = F.concat(F.lit("<Iteration>"), F.substring_index("value", "</Iteration>", 1))
    whole = F.when(ended, F.concat(inside, F.lit("</Iteration>"))).otherwise(inside)
    parsed = F.from_xml(whole, schema.replace("\n", " "), {"mode": "FAILFAST"})
    return pieces.where(ended | ~head).select(parsed.alias("iteration")).select("iteration.*")
