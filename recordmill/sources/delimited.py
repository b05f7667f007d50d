"""Records cut from text files by a delimiter, in file order.

Spark splits the files and reads the splits in parallel.  A first pass reduces
each split to one row (its record count); these rows are written once, counted,
and sent to the tasks, so every record gets its dense position where it was read.
Only for more than ``REPLICATED_SPLITS`` splits are records and splits joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordmill.plans.ordered import Running, running
from recordmill.session import materialize

# Record delimiters.
FASTA_SEPARATOR = "\n>"
ANY_GT_SEPARATOR = ">"
MOL2_PREFIX = "@<TRIPOS>MOLECULE"

Paths = str | list[str]
#: File splits whose offsets are replicated: about 100 bytes each.
REPLICATED_SPLITS = 400_000


def read_delimited(
    spark: SparkSession,
    paths: Paths,
    separator: str = "\n",
    *,
    glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """(file, block, pos, pos_in_file, n_in_file, value).

    ``pos`` is dense over all files in path order; ``value`` excludes the
    separator.  ``glob`` matches base names, as in ``*name`` for a suffix.
    """
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    blocks = materialize(blocks, "splits")
    few = blocks.count() <= REPLICATED_SPLITS
    # Files are totalled first, so the window over all of them has a row per file, not per split.
    files = blocks.groupBy("file").agg(F.sum("n").alias("n_in_file"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", "n_in_file", F.coalesce(F.sum("n_in_file").over(earlier), F.lit(0)).alias("before_file"))
    in_file = Window.partitionBy("file")
    offsets = blocks.select(
        "file",
        "block",
        "first_row",
        F.coalesce(
            F.sum("n").over(in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before_in_file"),
    ).join(files, "file")
    local = F.col("row") - F.col("first_row")
    return raw.join(F.broadcast(offsets) if few else offsets, ["file", "block"]).select(
        "file",
        "block",
        (F.col("before_file") + F.col("before_in_file") + local).alias("pos"),
        (F.col("before_in_file") + local).alias("pos_in_file"),
        "n_in_file",
        "value",
    )


def read_lines(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """(file, pos, line_no, value): ``line_no`` is 1-based within its file."""
    lines = read_delimited(spark, paths, "\n", **kw)
    return lines.select("file", "pos", (F.col("pos_in_file") + 1).alias("line_no"), "value")


def read_fasta(spark: SparkSession, paths: Paths, *, any_gt: bool = False, **kw) -> DataFrame:
    """(file, pos, byte_len, header, body, raw), one row per FASTA record.

    A record starts at ``>`` at the start of a line; text before the first one
    is a record of its own.  ``any_gt`` also cuts at a ``>`` inside a line.
    ``body`` is NULL for a record without a newline.
    """
    separator = ANY_GT_SEPARATOR if any_gt else FASTA_SEPARATOR
    found = read_delimited(spark, paths, separator, **kw)
    if any_gt:
        # The text before the first '>' is empty in a well-formed file.
        found = found.where((F.col("pos_in_file") > 0) | (F.col("value") != ""))
    first, last = F.col("pos_in_file") == 0, F.col("pos_in_file") == F.col("n_in_file") - 1
    tail = F.lit("") if any_gt else F.when(last, "").otherwise("\n")
    raw = F.concat(F.when(first, "").otherwise(">"), F.col("value"), tail)
    return _with_parts(found.select("file", "pos", raw.alias("raw")))


def _with_parts(records: DataFrame) -> DataFrame:
    cut = F.instr("raw", "\n")
    return records.select(
        "file",
        "pos",
        F.octet_length("raw").cast("long").alias("byte_len"),
        F.regexp_replace(F.substring_index("raw", "\n", 1), r"^>|\r$", "").alias("header"),
        F.when(cut > 0, F.substr("raw", cut + 1)).alias("body"),
        "raw",
    )


def normalize_breaks(raw: Column | str) -> Column:
    """CR and CRLF line breaks as LF."""
    return F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, r"\r\n?", "\n")


def with_byte_offsets(records: DataFrame) -> DataFrame:
    """Add ``byte_off``, the offset of each record in its file (narrow columns only)."""
    narrow = records.select("file", "pos", "byte_len")
    spec = Running("byte_off", F.col("byte_len"), exclusive=True)
    return running(narrow, "pos", [spec], within=["file"])


def read_mol2(spark: SparkSession, paths: Paths, **kw) -> DataFrame:
    """(file, pos, name, raw): one row per molecule; the name is its second line."""
    found = read_delimited(spark, paths, MOL2_PREFIX, **kw).where(F.col("pos_in_file") > 0)
    return found.select(
        "file",
        "pos",
        F.trim(F.split_part("value", F.lit("\n"), F.lit(2))).alias("name"),
        F.concat(F.lit(MOL2_PREFIX), "value").alias("raw"),
    )


def read_names(spark: SparkSession, paths: Paths) -> DataFrame:
    """Distinct trimmed lines, as a set of names."""
    return spark.read.text(paths).select(F.trim("value").alias("name")).distinct()


def count_records(spark: SparkSession, paths: Paths, separator: str = FASTA_SEPARATOR) -> int:
    return spark.read.option("lineSep", separator).text(paths).count()
