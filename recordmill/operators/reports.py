"""Hit tables, hit sequences and merging of search reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.text import clip_id, clip_organism, query_name
from recordmill.plans.ordered import Running, running

MAX_EVALUE = 0.001


def iterations(reports: DataFrame) -> DataFrame:
    """(doc, document_def, iter, iteration) from parsed documents, or from rows of iterations.

    Rows of iterations, as a merged file is read, count as those of one document, number 1.
    The outer form avoids the size test Spark derives from a plain explode,
    which would parse every document a second time.
    """
    if "report" not in reports.columns:
        return reports.select(
            F.lit(1).cast("long").alias("doc"),
            F.lit(None).cast("string").alias("document_def"),
            (F.col("`Iteration_iter-num`") - 1).alias("iter"),
            F.struct(*[F.col(f"`{c}`") for c in reports.columns]).alias("iteration"),
        )
    found = reports.select(
        "doc",
        F.col("report.`BlastOutput_query-def`").alias("document_def"),
        F.posexplode_outer("report.BlastOutput_iterations.Iteration").alias("iter", "iteration"),
    )
    return found.where("iter IS NOT NULL")


def hits(reports: DataFrame, keep: str = "last") -> DataFrame:
    """One row per hit (or per segment with ``keep='all'``).

    ``keep`` chooses the segment that stands for a hit: the last one reported,
    the best by e-value, or all of them.
    """
    found = iterations(reports).select(
        "doc",
        "document_def",
        "iter",
        F.col("iteration.`Iteration_query-def`").alias("iteration_def"),
        F.posexplode("iteration.Iteration_hits.Hit").alias("hit_no", "hit"),
    )
    segments = F.col("hit.Hit_hsps.Hsp")
    if keep == "all":
        return found.withColumn("segment", F.explode(segments))
    if keep == "best":
        keyed = F.transform(segments, lambda s, i: F.struct(s["Hsp_evalue"].cast("double").alias("e"), i.alias("i")))
        return found.withColumn("segment", F.get(segments, F.array_min(keyed)["i"]))
    if keep != "last":
        raise ValueError(f"keep must be last, best or all, not {keep!r}")
    return found.withColumn("segment", F.try_element_at(segments, F.lit(-1)))


def tab_hits(reports: DataFrame, keep: str = "last", max_evalue: float = MAX_EVALUE) -> DataFrame:
    """(query_id, hit_id, q_from, q_to, h_from, h_to, evalue, organism) of significant hits.

    An e-value that is not a number fails the job.
    """
    evalue = F.col("segment.Hsp_evalue").cast("double")
    number = F.col("segment.Hsp_evalue").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    checked = F.when(number, evalue).otherwise(F.raise_error(F.lit("e-value is not a number")).cast("double"))
    rows = hits(reports, keep).where("segment IS NOT NULL").where(checked <= max_evalue)
    return rows.select(
        "doc",
        "iter",
        "hit_no",
        query_name("iteration_def", "document_def").alias("query_id"),
        clip_id(F.col("hit.Hit_id"), force=True).alias("hit_id"),
        F.col("segment.`Hsp_query-from`").alias("q_from"),
        F.col("segment.`Hsp_query-to`").alias("q_to"),
        F.col("segment.`Hsp_hit-from`").alias("h_from"),
        F.col("segment.`Hsp_hit-to`").alias("h_to"),
        evalue.alias("evalue"),
        clip_organism(F.coalesce(F.col("hit.Hit_def"), F.lit(""))).alias("organism"),
    ).where("query_id IS NOT NULL")


def hit_sequences(reports: DataFrame, keep: str = "last") -> DataFrame:
    """(doc, iter, hit_no, header, sequence): the matched part of each hit, gaps kept."""
    return hits(reports, keep).select(
        "doc",
        "iter",
        "hit_no",
        F.col("hit.Hit_def").alias("header"),
        F.col("segment.Hsp_hseq").alias("sequence"),
    )


def renumber_iterations(reports: DataFrame) -> DataFrame:
    """(iter_num, doc, iteration): iterations of all documents numbered 1, 2, …."""
    rows = _with_ordinal(iterations(reports))
    return rows.select((F.col("n") + 1).alias("iter_num"), "doc", "iter", "iteration")


def _with_ordinal(rows: DataFrame) -> DataFrame:
    """Add ``n``: iterations of all earlier documents, plus the place in the own one."""
    counts = rows.groupBy("doc").agg(F.count("*").alias("count"))
    before = running(counts, "doc", [Running("before", F.col("count"), exclusive=True)]).select("doc", "before")
    return rows.join(before, "doc").withColumn("n", F.col("before") + F.col("iter")).drop("before")


def merge_reports(documents: DataFrame) -> DataFrame:
    """(line_no, value): the text of one merged document, as ordered rows.

    The first document's head stays up to its first iteration, then come all
    iterations renumbered, then one foot.  Rows are sorted and written as
    ordered parts; the merged document is never held in one place.
    """
    pieces = documents.select(
        "doc",
        F.regexp_extract("xml", r"(?s)^(.*?)<Iteration>", 1).alias("head"),
        F.regexp_extract_all("xml", F.lit(r"(?s)(<Iteration>.*?</Iteration>)"), F.lit(1)).alias("parts"),
    )
    first = documents.select(F.min("doc")).scalar()
    head = pieces.where(F.col("doc") == first).select(
        F.lit(0).cast("long").alias("line_no"), F.concat(F.lit('<?xml version="1.0"?>'), "head").alias("value")
    )
    exploded = pieces.select("doc", F.posexplode_outer("parts").alias("iter", "part")).where("iter IS NOT NULL")
    body = _with_ordinal(exploded).select((F.col("n") + 1).alias("line_no"), _with_number("part", F.col("n") + 1))
    foot = documents.sparkSession.range(1).select(
        F.lit(2**62).alias("line_no"), F.lit("  </BlastOutput_iterations>\n</BlastOutput>").alias("value")
    )
    return head.unionAll(body).unionAll(foot)


def _with_number(part: str, number: Column) -> Column:
    tag = F.concat(F.lit("<Iteration_iter-num>"), number.cast("string"), F.lit("</Iteration_iter-num>"))
    pattern = F.lit(r"<Iteration_iter-num>[^<]*</Iteration_iter-num>")
    return F.regexp_replace(F.col(part), pattern, tag).alias("value")
