"""Registered queries over the driver tables, each with its SQL check.

Every query reads its tables whole.  Where a query needs files (FASTA, blocks,
indexes, logs, reports), Spark writes them from the tables first.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions import residues as RES
from recordmill.functions import text as TXT
from recordmill.operators import clustering, inverted, masking, packing, provenance, records, recovery
from recordmill.operators import reports as rep
from recordmill.operators import retrieval, sampling, similarity, taxonomy, timelines
from recordmill.plans.ordered import Running, dense_positions, ordinal, running
from recordmill.session import scratch_path, ship_package
from recordmill.sources import blocks, collection, delimited, joblogs, tables, writers
from recordmill.sources import reports as xml
from recordmill.streaming import run_available, windows
from recordmill.streaming.feeds import parquet_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

WORD = 16
SAMPLES = 300
THRESHOLD = 50_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return run

    return register


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents")


def _sized(spark: SparkSession, sf: str, length: Column | None = None) -> DataFrame:
    """(doc_id, n): documents with a length, bytes by default.

    A key known to be non-null needs no null test, which would compute it twice.
    """
    n = TXT.byte_length("text") if length is None else length.cast("long")
    return _documents(spark, sf).select("doc_id", F.coalesce(n, F.lit(0)).alias("n"))


# Lengths, histograms, sampling -------------------------------------------------


@query(
    "SELECT doc_id AS id, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS length FROM documents"
)
def record_lengths(spark, sf):
    return records.length_report(_documents(spark, sf), "doc_id", TXT.letter_count("text").cast("long"))


_RESIDUES_SQL = "CAST(length(translate(text, chr(10) || chr(13) || chr(9) || ' ', '')) AS BIGINT)"


@query(f"""
SELECT n - 1 AS bin, n AS length, count(*) AS count, round(count(*) / max(count(*)) OVER (), 6) AS ratio
FROM (SELECT {_RESIDUES_SQL} AS n FROM documents) GROUP BY n
""")
def length_histogram(spark, sf):
    return records.length_histogram(_documents(spark, sf), TXT.residue_count("text").cast("long"))


@query(f"""
WITH d AS (SELECT doc_id, {_RESIDUES_SQL} AS n FROM documents),
     h AS (SELECT n, count(*) AS c, max(count(*)) OVER () AS top FROM d GROUP BY n),
     r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS k FROM d)
SELECT doc_id, r.n FROM r JOIN h USING (n)
WHERE k <= floor(c * 8 / top) AND (r.n - 1) % 2 = 0 AND r.n - 1 < 5000
""")
def stratified_first_k(spark, sf):
    rows = _sized(spark, sf, TXT.residue_count("text"))
    return records.first_k_per_bin(rows, "doc_id", "n", height=8, stride=2, max_length=5000)


_CREDIT_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents),
r AS MATERIALIZED (
  SELECT doc_id, (n BETWEEN 200 AND 4000) AS fit, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total
  FROM d WHERE n > 0),
s AS (
  SELECT CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS doc_id, FALSE AS hit
  UNION ALL
  SELECT r.i, s.taken + CASE WHEN r.fit AND r.i * {SAMPLES} >= s.taken * r.total THEN 1 ELSE 0 END, r.doc_id,
         r.fit AND r.i * {SAMPLES} >= s.taken * r.total
  FROM s JOIN r ON r.i = s.i + 1)
"""


@query(_CREDIT_SQL + "SELECT doc_id FROM s WHERE hit")
def credit_sample(spark, sf):
    rows = _sized(spark, sf, TXT.nonspace_count("text"))
    return sampling.credit_sample(rows, "doc_id", "n", SAMPLES, low=200, high=4000).select("doc_id")


@query(_CREDIT_SQL + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE hit)")
def credit_sample_rest(spark, sf):
    rows = _sized(spark, sf, TXT.nonspace_count("text"))
    return sampling.credit_sample_rest(rows, "doc_id", "n", SAMPLES, low=200, high=4000).select("doc_id")


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE n BETWEEN 200 AND 4000) AS in_bounds
FROM (SELECT length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents) WHERE n > 0
""")
def range_count(spark, sf):
    return records.range_summary(_documents(spark, sf), TXT.nonspace_count("text"), 200, 4000)


# Ordering, splitting, packing --------------------------------------------------


@query("""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS rank
FROM documents
""")
def longest_first(spark, sf):
    return records.longest_first(_sized(spark, sf), "doc_id", "n")


@query("""
WITH d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents),
     o AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS byte_off FROM d),
     e AS (SELECT i, CAST((i + 1) * (SELECT sum(n) FROM d) // 16 AS BIGINT) AS edge FROM range(16) t(i))
SELECT doc_id, n, byte_off, min(i) AS part FROM o JOIN e ON byte_off < edge GROUP BY ALL
""")
def byte_split(spark, sf):
    return packing.byte_split(_sized(spark, sf), "doc_id", "n", 16)


@query("""
WITH d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n,
                  row_number() OVER (ORDER BY strlen(text) DESC, doc_id) - 1 AS rank FROM documents),
     o AS (SELECT doc_id, rank, n, CAST(sum(n) OVER (ORDER BY rank) - n AS BIGINT) AS off FROM d),
     e AS (SELECT i, CAST((i + 1) * (SELECT sum(n) FROM d) // 16 AS BIGINT) AS edge FROM range(16) t(i)),
     p AS (SELECT doc_id, n, min(i) AS part FROM o JOIN e ON off < edge GROUP BY ALL)
SELECT part, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes FROM p GROUP BY part
""")
def balanced_parts(spark, sf):
    """Longest-first order cut into parts of equal bytes."""
    ranked = records.longest_first(_sized(spark, sf), "doc_id", "n").withColumn("rank", F.col("rank") - 1)
    parts = packing.byte_split(ranked.select("rank", "n"), "rank", "n", 16)
    return parts.groupBy("part").agg(F.count("*").alias("records"), F.sum("n").alias("bytes"))


def _pack_sql(threshold: str) -> str:
    """The packing loop as a recursive query; ``threshold`` is a scalar query."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
t AS ({threshold}),
s AS (
  SELECT i, doc_id, n, n AS acc, CAST(0 AS BIGINT) AS block FROM d WHERE i = 1
  UNION ALL
  SELECT d.i, d.doc_id, d.n, CASE WHEN s.acc >= t.t THEN d.n ELSE s.acc + d.n END,
         CASE WHEN s.acc >= t.t THEN s.block + 1 ELSE s.block END
  FROM s JOIN d ON d.i = s.i + 1 CROSS JOIN t)
SELECT doc_id, n, block FROM s
"""


@query(_pack_sql(f"SELECT {THRESHOLD} AS t"))
def greedy_pack(spark, sf):
    return packing.greedy_pack(_sized(spark, sf), "doc_id", "n", THRESHOLD)


@query(_pack_sql("SELECT CAST(sum(n) // 24 AS BIGINT) AS t FROM d"))
def pack_into_parts(spark, sf):
    return packing.pack_into(_sized(spark, sf), "doc_id", "n", 24, name="block")


@query("SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 7 AS part FROM pages")
def fixed_groups(spark, sf):
    return records.fixed_groups(tables.table(spark, sf, "pages").select("page_id"), "page_id", 7)


@query("""
WITH d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents),
     o AS (SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS off FROM d),
     e AS (SELECT i, CAST((i + 1) * (SELECT sum(n) FROM d) // 8 AS BIGINT) AS edge FROM range(8) t(i)),
     p AS (SELECT doc_id, min(i) AS part FROM o JOIN e ON off < edge GROUP BY ALL)
SELECT CAST(part AS INTEGER) AS part, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 2) AS BIGINT) AS lines
FROM p JOIN documents USING (doc_id) GROUP BY part
""")
def numbered_parts(spark, sf):
    """Byte-balanced FASTA parts written to numbered folders and read back."""
    parts = packing.byte_split(_sized(spark, sf), "doc_id", "n", 8).select("doc_id", "part")
    raw = writers.fasta_text(F.col("doc_id").cast("string"), "text")
    path = scratch_path(spark, "parts")
    rows = _documents(spark, sf).join(parts, "doc_id").select("doc_id", "part", raw.alias("raw"))
    writers.write_parts(rows, path, order="doc_id")
    return spark.read.text(path).groupBy("part").agg(F.count("*").alias("lines"))


@query("""
SELECT CAST(l_suppkey // 100 AS INTEGER) AS hh, CAST(l_suppkey % 100 AS INTEGER) AS ll, count(*) AS rows
FROM lineitem GROUP BY ALL
""")
def spread_folders(spark, sf):
    """Rows spread over HH/LL folders by worker number."""
    path = scratch_path(spark, "spread")
    rows = tables.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    writers.write_spread(rows, path, "l_suppkey")
    files = writers.read_spread(spark, path).groupBy("file").agg(F.count("*").alias("rows"))
    return files.groupBy(*writers.folder_numbers(F.col("file"))).agg(F.sum("rows").alias("rows"))


# Dedup, name joins, recovery ---------------------------------------------------


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_first(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "text")
    return records.distinct_first(rows, "doc_id", F.col("text")).select("doc_id")


@query("""
SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
WHERE doc_id > first
""")
def duplicates_reported(spark, sf):
    return records.duplicates(_documents(spark, sf).select("doc_id", "text"), "doc_id", F.col("text"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_by_name(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "lang")
    return records.named(rows, tables.table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_by_name(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "lang")
    return records.not_named(rows, tables.table(spark, sf, "labels"), "doc_id")


@query("""
WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS slot, count(*) OVER () AS n FROM benchmark),
     d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, i, item_id AS cycle_item_id FROM d JOIN b ON d.i % b.n = b.slot
""")
def cyclic_zip(spark, sf):
    cycle = tables.table(spark, sf, "benchmark").select("item_id")
    return records.cyclic_zip(_documents(spark, sf).select("doc_id"), "doc_id", cycle, "item_id")


def _label_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two logs from the labels: quality settles a block, a toxic mark overrides it."""
    labels = tables.table(spark, sf, "labels")
    first = labels.select(
        F.lit("a").alias("file"),
        F.col("doc_id").alias("line_no"),
        F.when(F.col("quality") == 1, "S").otherwise("E").alias("status"),
        F.col("doc_id").alias("block_id"),
    )
    second = labels.where("toxic = 1").select(
        F.lit("b").alias("file"), F.col("doc_id").alias("line_no"), F.lit("E").alias("status"), "doc_id"
    )
    return first.unionAll(second)


_OUTCOME_SQL = """
SELECT d.doc_id AS block_id, CASE WHEN l.doc_id IS NULL THEN 'resume'
  WHEN l.toxic = 1 OR l.quality <> 1 THEN 'failed' ELSE 'success' END AS outcome
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


@query(_OUTCOME_SQL)
def status_left_join(spark, sf):
    ids = _documents(spark, sf).select(F.col("doc_id").alias("block_id"))
    return recovery.classify_blocks(ids, _label_log(spark, sf))


@query(f"SELECT outcome, count(*) AS records FROM ({_OUTCOME_SQL}) GROUP BY outcome")
def status_counts(spark, sf):
    return recovery.outcome_counts(status_left_join(spark, sf))


@query("""
WITH k AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS s,
                  count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id),
     r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)
SELECT event_id, user_id, CASE WHEN nth <= s THEN 'success' WHEN nth <= s + e THEN 'failed' ELSE 'resume' END AS outcome
FROM r JOIN k USING (user_id)
""")
def multiset_classify(spark, sf):
    events = tables.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "S").when(F.col("event_type") == "error", "E")
    log = events.select(F.col("user_id").alias("key"), status.alias("status")).where("status IS NOT NULL")
    return recovery.classify_records(events.select("event_id", "user_id"), "event_id", "user_id", log)


# Ordered logs ------------------------------------------------------------------


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS last_signup FROM events
""")
def carry_forward_last(spark, sf):
    events = tables.table(spark, sf, "events")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = events.select("event_id", signup.alias("signup"))
    carried = timelines.carry_forward(rows, "event_id", F.col("signup"), "last_signup", initial=-1)
    return carried.select("event_id", "last_signup")


_INTERVAL_SQL = """
WITH m AS (SELECT event_id, user_id, epoch_us(ts) AS t,
             CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS sign FROM events),
     d AS (SELECT *, sum(sign) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM m WHERE sign <> 0),
     l AS (SELECT *, CASE WHEN sign > 0 THEN depth ELSE depth + 1 END AS level FROM d),
     n AS (SELECT *, lead(sign) OVER w AS next_sign, lead(t) OVER w AS next_t FROM l
           WINDOW w AS (PARTITION BY user_id, level ORDER BY event_id))
SELECT user_id, event_id, t AS t0,
  CAST(CASE WHEN next_sign = -1 THEN next_t ELSE (SELECT max(t) FROM m) END - t AS BIGINT) AS dur,
  coalesce(next_sign = -1, FALSE) AS closed
FROM n WHERE sign > 0
"""


@query(_INTERVAL_SQL)
def interval_build(spark, sf):
    rows = tables.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", timelines.wall_micros("ts").alias("t")
    )
    kind = F.col("event_type")
    return timelines.build_intervals(rows, "event_id", ["user_id"], kind == "view", kind == "purchase", "t")


@query("""
WITH w AS (SELECT event_id, user_id // 12 AS slave, user_id % 12 AS worker, event_type,
                  CAST(event_id AS DOUBLE) / 4 AS t FROM events),
     m AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS sign FROM w),
     d AS (SELECT *, sum(sign) OVER (PARTITION BY slave, worker ORDER BY event_id) AS depth FROM m WHERE sign <> 0),
     l AS (SELECT *, CASE WHEN sign > 0 THEN depth ELSE depth + 1 END AS level FROM d),
     n AS (SELECT *, lead(sign) OVER w AS next_sign, lead(t) OVER w AS next_t FROM l
           WINDOW w AS (PARTITION BY slave, worker, level ORDER BY event_id))
SELECT CAST(slave AS INTEGER) AS slave, CAST(worker AS INTEGER) AS worker, t AS t0,
  CASE WHEN next_sign = -1 THEN next_t ELSE (SELECT max(t) FROM m) END - t AS dur,
  coalesce(next_sign = -1, FALSE) AS closed
FROM n WHERE sign > 0
""")
def timing_log_intervals(spark, sf):
    """Events written as timing lines, read back and paired."""
    events = tables.table(spark, sf, "events").orderBy("event_id")
    name = F.when(F.col("event_type") == "view", "beginning search").when(
        F.col("event_type") == "purchase", "done with search"
    )
    line = F.format_string(
        "[%d] [TIMING] Slave %d, Worker %d %s at %s.",
        "event_id",
        F.expr("user_id div 12"),
        F.expr("user_id % 12"),
        F.coalesce(name, F.lit("Requesting")),
        (F.col("event_id") / 4).cast("string"),
    )
    path = scratch_path(spark, "timing-log")
    events.select(line.alias("value")).write.text(path)
    timing = joblogs.parse_timing_log(delimited.read_lines(spark, path))
    begins, ends = F.col("event") == joblogs.TIMING_BEGIN, F.col("event") == joblogs.TIMING_DONE
    return timelines.build_intervals(timing, "pos", ["slave", "worker"], begins, ends, "t").drop("pos")


@query("""
SELECT n - 1 AS pos, coalesce(last_value(CASE WHEN event_type = 'view' THEN 'ZINC' || user_id END IGNORE NULLS)
  OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'None') AS molecule
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events)
QUALIFY event_type = 'error'
""")
def growth_log_failures(spark, sf):
    """Events written as a growth log: the molecule in work at each error."""
    events = tables.table(spark, sf, "events").orderBy("event_id")
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("Molecule: ZINC"), "user_id"))
        .when(kind == "error", joblogs.GROWTH_ERROR)
        .otherwise(kind)
    )
    path = scratch_path(spark, "growth-log")
    events.select(line.alias("value")).write.text(path)
    return timelines.failed_molecules(joblogs.parse_growth_log(delimited.read_lines(spark, path)))


@query(_OUTCOME_SQL)
def block_log_outcomes(spark, sf):
    """The labels written as block logs, parsed and applied; the later file wins."""
    root = scratch_path(spark, "block-logs")
    log = _label_log(spark, sf)
    code = F.when(F.col("status") == "E", "E3").otherwise("S")
    line = F.concat(code, F.lit("\t"), F.col("block_id").cast("string"))
    comment = spark.range(1).select(F.lit("# block status").alias("value"))
    for name in ("a", "b"):
        lines = log.where(F.col("file") == name).select(line.alias("value"))
        comment.unionAll(lines).write.text(f"{root}/{name}")
    parsed = joblogs.parse_block_log(delimited.read_lines(spark, root, recursive=True))
    ids = _documents(spark, sf).select(F.col("doc_id").alias("block_id"))
    return recovery.classify_blocks(ids, parsed)


@query("""
WITH x AS (SELECT doc_id, substr(hex(encode(CASE WHEN contains('>' || lang || chr(10) || text, chr(10))
             THEN '>' || lang || chr(10) || text END)), 1, 64) AS key FROM documents),
     k AS (SELECT key, count(*) FILTER (WHERE quality = 1) AS s, count(*) FILTER (WHERE quality <> 1) AS e
           FROM x JOIN labels USING (doc_id) GROUP BY key),
     r AS (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth FROM x)
SELECT doc_id, CASE WHEN nth <= coalesce(s, 0) THEN 'success'
  WHEN nth <= coalesce(s, 0) + coalesce(e, 0) THEN 'failed' ELSE 'resume' END AS outcome
FROM r LEFT JOIN k USING (key)
""")
def key_log_outcomes(spark, sf):
    """Record-keyed recovery: labelled documents were logged under their 32-byte key."""
    raw = F.concat(F.lit(">"), "lang", F.lit("\n"), "text")
    rows = _documents(spark, sf).select("doc_id", F.hex(TXT.recovery_key(raw)).alias("key"))
    status = F.when(F.col("quality") == 1, "SUCC ").otherwise("E 3  ")
    lines = rows.join(tables.table(spark, sf, "labels"), "doc_id").select(F.concat(status, "key").alias("value"))
    path = scratch_path(spark, "key-log")
    lines.write.text(path)
    log = joblogs.parse_key_log(delimited.read_lines(spark, path))
    return recovery.classify_records(rows, "doc_id", "key", log).select("doc_id", "outcome")


# Provenance --------------------------------------------------------------------


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a dense position, in the order of conversation and turn."""
    return dense_positions(tables.table(spark, sf, "conversations"), ["conv_id", "turn"], "seq")


@query("""
SELECT conv_id, turn, role, CAST(strlen(text) AS BIGINT) AS size,
  CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS voffset,
  CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY role ORDER BY conv_id, turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS poffset
FROM conversations
""")
def offsets(spark, sf):
    turns = _turns(spark, sf).select("conv_id", "turn", "role", "seq", TXT.byte_length("text").alias("size"))
    return provenance.chunk_offsets(turns, "seq", "size", ["conv_id"], ["role"]).drop("seq")


def _reassemble_sql(part_bytes: int) -> str:
    return f"""
WITH o AS (SELECT *, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text)) // {part_bytes}
             AS part FROM conversations)
SELECT conv_id, CAST(part AS BIGINT) AS part, string_agg(text, '' ORDER BY turn) AS text FROM o GROUP BY ALL
"""


@query(_reassemble_sql(provenance.PART_BYTES))
def reassemble(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    return provenance.reassemble(turns, ["conv_id"], "turn", "text")


@query(_reassemble_sql(2048))
def reassemble_small_parts(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    return provenance.reassemble(turns, ["conv_id"], "turn", "text", part_bytes=2048)


@query("SELECT CAST(turn AS INTEGER) AS stream, text FROM conversations")
def chunk_files(spark, sf):
    """Turns written as chunk files, found again through the 30-byte index."""
    path = scratch_path(spark, "chunks")
    turns = _turns(spark, sf).select(F.col("turn").alias("stream"), F.col("seq").alias("voffset"), F.col("text"))
    blocks.write_chunks(turns.withColumnRenamed("text", "payload"), path)
    index = blocks.read_chunk_index(spark, path, glob="*.idx")
    return provenance.gather(index).select("stream", F.decode("payload", "UTF-8").alias("text"))


@query("""
SELECT CAST(turn AS INTEGER) AS stream, count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes
FROM conversations GROUP BY 1
""")
def chunk_index_listing(spark, sf):
    path = scratch_path(spark, "chunks")
    turns = _turns(spark, sf).select(F.col("turn").alias("stream"), F.col("seq").alias("voffset"), F.col("text"))
    blocks.write_chunks(turns.withColumnRenamed("text", "payload"), path)
    index = blocks.read_chunk_index(spark, path, glob="*.idx")
    return index.groupBy("stream").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@query("SELECT conv_id || ' ' || turn || ' ' || text AS payload FROM conversations")
def block_file_v1(spark, sf):
    return _block_round_trip(spark, sf, 1)


@query("SELECT conv_id || ' ' || turn || ' ' || text AS payload FROM conversations")
def block_file_v2(spark, sf):
    return _block_round_trip(spark, sf, 2)


def _block_round_trip(spark: SparkSession, sf: str, version: int) -> DataFrame:
    path = scratch_path(spark, "blocks")
    turns = tables.table(spark, sf, "conversations")
    payload = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text")
    blocks.write_blocks(turns.select(payload.alias("payload")), path, version=version)
    return blocks.read_blocks(spark, path, version=version).select(F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT count(*) AS blocks FROM conversations")
def block_count(spark, sf):
    """Blocks counted by walking lengths only; payloads are not read."""
    path = scratch_path(spark, "blocks")
    blocks.write_blocks(tables.table(spark, sf, "conversations").select(F.col("text").alias("payload")), path)
    index = blocks.read_block_index(blocks.list_files(spark, path))
    return blocks.block_counts(index).where("file IS NULL").select("blocks")


@query("""
SELECT l_returnflag AS file, count(*) AS blocks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes
FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def rollup_blocks(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("file"), F.col("l_quantity").cast("long").alias("stored_size")
    )
    return blocks.block_counts(rows)


# Record files ------------------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id, strlen('>' || doc_id || ' ' || source || chr(10) || text || chr(10)) AS n,
                  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(n AS BIGINT) AS byte_len,
       CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS byte_off, CAST(letters AS BIGINT) AS letters
FROM r
""")
def fasta_scan(spark, sf):
    """Documents written as FASTA parts and read back with ids, positions and offsets."""
    path = scratch_path(spark, "fasta")
    rows = _documents(spark, sf).orderBy("doc_id")
    header = F.concat_ws(" ", F.col("doc_id").cast("string"), "source")
    writers.write_fasta(rows.select(header.alias("header"), F.col("text").alias("sequence")), path)
    found = delimited.read_fasta(spark, path).select(
        "pos",
        "byte_len",
        TXT.record_id("header").alias("id"),
        TXT.letter_count("body").cast("long").alias("letters"),
    )
    return running(found, "pos", [Running("byte_off", F.col("byte_len"), exclusive=True)])


@query("""
SELECT CAST(doc_id AS VARCHAR) AS name, CAST(strlen('@<TRIPOS>MOLECULE' || chr(10) || doc_id || chr(10) || text) AS BIGINT)
  AS bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def mol2_by_name(spark, sf):
    """Documents as molecule records, kept when their second line is a listed name."""
    path, names = scratch_path(spark, "mol2"), scratch_path(spark, "names")
    raw = F.concat_ws("\n", F.lit(delimited.MOL2_PREFIX), F.col("doc_id").cast("string"), "text")
    _documents(spark, sf).select(raw.alias("value")).write.text(path)
    tables.table(spark, sf, "labels").select(F.concat(F.lit("  "), "doc_id", F.lit(" ")).alias("value")).write.text(names)
    found = records.named(delimited.read_mol2(spark, path), delimited.read_names(spark, names))
    return found.select("name", F.octet_length(F.regexp_replace("raw", "\n$", "")).cast("long").alias("bytes"))


@query("""
SELECT c_custkey AS pos, u.ord AS ord, CAST(CASE u.ord WHEN 0 THEN c_custkey ELSE c_nationkey END AS VARCHAR) AS gi,
  CASE u.ord WHEN 0 THEN 'ref' ELSE 'sp' END AS db, CASE u.ord WHEN 0 THEN c_name ELSE n_name END AS acc,
  CASE u.ord WHEN 0 THEN c_mktsegment || ' [' || n_name || ']' ELSE 'nation' END AS title,
  CASE u.ord WHEN 0 THEN n_name ELSE '' END AS organism
FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest([0, 1]) AS ord) u
""")
def deflines(spark, sf):
    customer, nation = tables.table(spark, sf, "customer"), tables.table(spark, sf, "nation")
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    own = F.concat(
        F.lit("gi|"), "c_custkey", F.lit("|ref|"), "c_name", F.lit("| "), "c_mktsegment", F.lit(" ["), "n_name", F.lit("]")
    )
    other = F.concat(F.lit("gi|"), "c_nationkey", F.lit("|sp|"), "n_name", F.lit("| nation"))
    lines = rows.select(F.col("c_custkey").alias("pos"), F.concat_ws("\x01", own, other).alias("header"))
    return lines.select("pos", F.posexplode(TXT.deflines("header")).alias("ord", "d")).select("pos", "ord", "d.*")


@query("""
SELECT page_id, CAST(page_id AS VARCHAR) AS gi, split_part(url, '|', 1) AS plain, '' AS forced,
  coalesce(nullif(regexp_extract(html, '\\[([^\\]]*)\\]', 1), ''), '') AS organism
FROM pages
""")
def clip_fields(spark, sf):
    named = F.concat(F.lit("gi|"), "page_id", F.lit("|ref|"), "url")
    return tables.table(spark, sf, "pages").select(
        "page_id",
        TXT.clip_id(named).alias("gi"),
        TXT.clip_id("url").alias("plain"),
        TXT.clip_id("url", force=True).alias("forced"),
        TXT.clip_organism("html").alias("organism"),
    )


@query("""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines,
  CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS commas FROM documents
""")
def char_counts(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        TXT.char_count("text", "\n").cast("long").alias("lines"),
        TXT.char_count("text", ",").cast("long").alias("commas"),
    )


# Sequences ---------------------------------------------------------------------

_NUCLEOTIDES_SQL = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


def _nucleotides() -> Column:
    return F.regexp_replace(F.upper("text"), "[^ACGT]+", "")


@query(f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_NUCLEOTIDES_SQL}, '...'),
  lambda c: substr('{RES.GENETIC_CODES[11]}',
    CAST(16 * (strpos('TCAG', c[1]) - 1) + 4 * (strpos('TCAG', c[2]) - 1) + strpos('TCAG', c[3]) AS BIGINT), 1)), '')
  AS protein FROM documents
""")
def translation(spark, sf):
    rows = _documents(spark, sf).select("doc_id", _nucleotides().alias("seq"))
    return rows.select("doc_id", RES.translate_codons("seq", 11).alias("protein"))


@query(f"""
SELECT doc_id AS id, reverse(translate(substr({_NUCLEOTIDES_SQL}, 11, 50), 'ACGT', 'TGCA')) AS sequence
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def fetch_bottom_strand(spark, sf):
    """Records by id: a range of the other strand."""
    rows = _documents(spark, sf).select("doc_id", _nucleotides().alias("seq"))
    good = tables.table(spark, sf, "labels").where("quality = 1")
    return retrieval.fetch(rows, good, "doc_id", "seq", start=11, stop=60, bottom_strand=True)


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'), '(.{1,60})', '\\1' || chr(10), 'g'), chr(10))
  AS lines FROM documents
""")
def wrapped_lines(spark, sf):
    """Sequences broken into lines of sixty letters."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return _documents(spark, sf).select("doc_id", RES.wrap_lines(letters, 60).alias("lines"))


@query("""
WITH q AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark),
     w AS (SELECT item_id, s, unnest(generate_series(0, length(s) - 12)) AS i FROM q)
SELECT item_id AS id, CAST(i AS INTEGER) AS start, substr(s, i + 1, 12) AS word FROM w
WHERE (i >= 10 AND i + 12 <= 60) OR (i >= 80 AND i + 12 <= 120)
""")
def masked_words(spark, sf):
    """Words that lie inside the allowed ranges of a record."""
    found = similarity.words(tables.table(spark, sf, "benchmark"), "item_id", "text", 12)
    span = lambda a, b: F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"))
    inside = RES.allowed_position(F.col("at"), 12, F.array(span(10, 60), span(80, 120)))
    return found.where(inside).withColumnRenamed("at", "start")


_TRANSITIONS = {(a, b): (2 if a == b else -1 if {a, b} in ({"A", "G"}, {"C", "T"}) else -3) for a in "ACGT" for b in "ACGT"}


@query(f"""
WITH s AS (SELECT doc_id, {_NUCLEOTIDES_SQL} AS s FROM documents),
     p AS (SELECT doc_id, substr(s, k, 2) AS ab FROM s, unnest(range(1, greatest(length(s), 1))) AS t(k))
SELECT doc_id, CAST(sum(CASE WHEN ab[1] = ab[2] THEN 2 WHEN ab IN ('AG', 'GA', 'CT', 'TC') THEN -1 ELSE -3 END) AS BIGINT)
  AS score FROM p GROUP BY doc_id
""")
def substitution_scores(spark, sf):
    """Sum of substitution scores over consecutive residue pairs."""
    # Pairs overlap: a look-ahead takes two residues and moves on by one.
    pairs = F.regexp_extract_all(_nucleotides(), F.lit("(?=(..))."), F.lit(1))
    rows = _documents(spark, sf).select("doc_id", F.explode_outer(pairs).alias("ab")).where("ab IS NOT NULL")
    score = RES.substitution_score(F.substring("ab", 1, 1), F.substring("ab", 2, 1), _TRANSITIONS)
    return rows.groupBy("doc_id").agg(F.sum(score).alias("score"))


@query("SELECT doc_id AS id FROM documents")
def id_list_binary(spark, sf):
    """Ids packed into binary lists and unpacked again."""
    return blocks.binary_to_ids(blocks.ids_to_binary(_documents(spark, sf), "doc_id"))


@query("SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return tables.duplicate_ids(tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE text NOT IN (SELECT text FROM documents)")
def merge_collections(spark, sf):
    first = _documents(spark, sf).select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("key"))
    second = tables.table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), "text", F.sha2("text", 256).alias("key")
    )
    return retrieval.merge_collections(first, second, key="key").drop("key")


# Retrieval ---------------------------------------------------------------------


@query("""
WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT term, count(*) AS records FROM p GROUP BY term
""")
def term_counts(spark, sf):
    return retrieval.term_counts(_documents(spark, sf), "doc_id", "text")


@query("""
SELECT doc_id FROM documents
WHERE regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)')
  AND (regexp_matches(lower(text), '(^|[^a-z])for([^a-z]|$)') OR regexp_matches(lower(text), '(^|[^a-z])with([^a-z]|$)'))
  AND NOT regexp_matches(lower(text), '(^|[^a-z])was([^a-z]|$)') AND n_chars BETWEEN 200 AND 5000
""")
def boolean_retrieval(spark, sf):
    """the AND (for OR with) BUTNOT was, within a RANGE of lengths, from the postings of an index."""
    index = _document_index(spark, sf)
    term = lambda t: inverted.Term("text", t)
    wanted = inverted.all_of(term("the"), inverted.any_of(term("for"), term("with")), inverted.Range("n_chars", 200, 5000))
    return index.retrieve(inverted.ButNot(wanted, term("was"))).select(F.col("id").alias("doc_id"))


def _document_index(spark: SparkSession, sf: str) -> inverted.Index:
    path = scratch_path(spark, "inverted")
    inverted.write_index(
        _documents(spark, sf), "doc_id", path, words={"text": "text"}, keys={"lang": "lang", "source": "source"}, numbers={"n_chars": "n_chars"}
    )
    return inverted.Index.open(spark, path)


@query("""
SELECT doc_id FROM documents
WHERE (lang = 'en' OR lang = 'de') AND NOT (source = (SELECT min(source) FROM documents) AND n_chars >= 1000)
""")
def fielded_retrieval(spark, sf):
    """Whole keys of two fields and a range: (en OR de) BUTNOT (the first source AND long)."""
    index = _document_index(spark, sf)
    first = index.term_counts("source").agg(F.min("term")).first()[0]
    language = inverted.terms("lang", ["en", "de"])
    long_ = inverted.all_of(inverted.Term("source", first or ""), inverted.Range("n_chars", 1000, 1 << 60))
    return index.retrieve(inverted.ButNot(language, long_)).select(F.col("id").alias("doc_id"))


@query("""
WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS records FROM p GROUP BY term
""")
def dictionary_counts(spark, sf):
    """Records of every word, from the index's dictionary."""
    return _document_index(spark, sf).term_counts("text")


# Taxa: regions, nations in them, customers in these; orders carry two bit arrays.
_TAXA_SQL = """
taxa AS (SELECT r_regionkey AS node, NULL AS parent FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey FROM customer)
"""


def _taxa(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: tables.table(spark, sf, name)
    level = lambda df, node, parent: df.select(node.cast("long").alias("node"), parent.cast("long").alias("parent"))
    return (
        level(t("region"), F.col("r_regionkey"), F.lit(None))
        .unionAll(level(t("nation"), F.col("n_nationkey") + 100, F.col("n_regionkey")))
        .unionAll(level(t("customer"), F.col("c_custkey") + 1000, F.col("c_nationkey") + 100))
    )


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with deflines: the first of the customer, with status and month as bits; a bare second one."""
    bits = taxonomy.bit_array(F.array(F.ascii("o_orderstatus") - 64, F.month("o_orderdate") + 32), 2)
    lines = F.array(
        F.struct((F.col("o_custkey") + 1000).alias("taxid"), bits.alias("memberships")),
        F.struct((F.col("o_custkey") % 5).alias("taxid"), F.array(F.lit(0).cast("long")).alias("memberships")),
    )
    return tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey", bits.alias("bits"), lines.alias("deflines"))


@query(f"""
WITH RECURSIVE {_TAXA_SQL},
sub AS (SELECT node FROM taxa WHERE node IN (2, 107) UNION SELECT taxa.node FROM taxa JOIN sub ON parent = sub.node)
SELECT o_orderkey FROM orders WHERE 1000 + o_custkey IN (SELECT node FROM sub) AND month(o_orderdate) = 3
""")
def records_below_taxon(spark, sf):
    """Records with a defline below two taxa that is in membership 35."""
    numbered = taxonomy.number_taxa(_taxa(spark, sf))
    return taxonomy.below_by_defline(_order_lines(spark, sf), "o_orderkey", "deflines", numbered, [2, 107], 35).select("o_orderkey")


@query("""
SELECT o_custkey AS key, bit_or(CAST(1 AS BIGINT) << (ascii(o_orderstatus) - 64)) AS word_0,
  bit_or(CAST(1 AS BIGINT) << month(o_orderdate)) AS word_1 FROM orders GROUP BY 1
""")
def membership_unions(spark, sf):
    """All memberships of each customer's orders."""
    merged = taxonomy.union_members(_order_lines(spark, sf), "o_custkey", "bits")
    return merged.select("key", F.col("bits")[0].alias("word_0"), F.col("bits")[1].alias("word_1"))


@query("""
SELECT k, count(*) AS records FROM (
  SELECT unnest([ascii(o_orderstatus) - 64, 32 + CAST(month(o_orderdate) AS INT)]) AS k FROM orders) GROUP BY k
""")
def membership_counts(spark, sf):
    return taxonomy.member_counts(_order_lines(spark, sf), "bits")


@query("""
SELECT doc_id AS id FROM (
  (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')
  EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)
""")
def id_set_algebra(spark, sf):
    labels = tables.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    english = _documents(spark, sf).where("lang = 'en'").select(F.col("doc_id").alias("id"))
    good, toxic = labels.where("quality = 1").select("id"), labels.where("toxic = 1").select("id")
    return retrieval.but_not(retrieval.both(good, english), toxic)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 20")
def result_page(spark, sf):
    """Third page of twenty, two pages long, of the longest documents."""
    rows = _documents(spark, sf).select("doc_id", "n_chars")
    return retrieval.page(rows, ["n_chars", "doc_id"], 20, 40, descending=[True, False])


@query("""
SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
""")
def link_traversal(spark, sf):
    """Customers to orders to parts along two link tables."""
    customers = tables.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    items = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return retrieval.linked(retrieval.linked(customers, orders, "c_custkey", "o_orderkey"), items, "o_orderkey", "l_partkey")


@query("SELECT o_custkey, count(*) AS links FROM orders GROUP BY 1")
def link_counts(spark, sf):
    return retrieval.link_counts(tables.table(spark, sf, "orders"), "o_custkey")


@query("""
SELECT n_name, p_brand, count(*) AS items,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
""")
def broadcast_dim_join(spark, sf):
    """A large table against replicated small ones; sizes decide what is replicated."""
    t = lambda name: tables.table(spark, sf, name)
    joined = (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return joined.groupBy("n_name", "p_brand").agg(F.count("*").alias("items"), revenue.alias("revenue"))


# Similarity search -------------------------------------------------------------

def _seeds_sql(word: int, least: int) -> str:
    return f"""
q AS (SELECT item_id AS query_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark),
d AS (SELECT doc_id AS db_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents),
qw AS (SELECT query_id, i, substr(s, i, {word}) AS word
       FROM (SELECT query_id, s, unnest(generate_series(1, length(s) - {word} + 1)) AS i FROM q)),
dw AS (SELECT db_id, i, substr(s, i, {word}) AS word
       FROM (SELECT db_id, s, unnest(generate_series(1, length(s) - {word} + 1)) AS i FROM d)),
seeds AS (SELECT query_id, db_id, CAST(dw.i - qw.i AS BIGINT) AS diagonal, count(*) AS seeds
          FROM dw JOIN qw USING (word) GROUP BY ALL HAVING count(*) >= {least})
"""


_SEEDS_SQL = _seeds_sql(WORD, 2)


def _ungapped_sql(query_table: str, record_table: str, match: int, mismatch: int) -> str:
    """Best stretch per diagonal: running sum minus lowest earlier sum."""
    return f"""
overlap AS (SELECT query_id, db_id, diagonal, seeds, q.s AS qs, d.s AS ds,
   unnest(generate_series(greatest(1, 1 - diagonal), least(length(q.s), length(d.s) - diagonal))) AS i
   FROM seeds JOIN q USING (query_id) JOIN d USING (db_id)),
gain AS (SELECT query_id, db_id, diagonal, seeds, i, length(qs) AS q_len, length(ds) AS d_len,
   CASE WHEN substr(qs, i, 1) = substr(ds, i + diagonal, 1) THEN {match} ELSE {mismatch} END AS g FROM overlap),
sums AS (SELECT *, sum(g) OVER w AS upto, sum(g) OVER w - g AS before FROM gain
   WINDOW w AS (PARTITION BY query_id, db_id, diagonal ORDER BY i)),
low AS (SELECT *, upto - min(before) OVER (PARTITION BY query_id, db_id, diagonal ORDER BY i) AS score,
   min(before) OVER (PARTITION BY query_id, db_id, diagonal ORDER BY i) AS floor_sum FROM sums),
best AS (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY query_id, db_id, diagonal ORDER BY score DESC, i) = 1),
hits AS (SELECT b.query_id, b.db_id, b.diagonal, b.seeds, b.q_len, b.d_len, CAST(b.score AS BIGINT) AS score,
   CAST(max(l.i) AS BIGINT) AS q_from, CAST(b.i AS BIGINT) AS q_to
   FROM best b JOIN sums l ON l.query_id = b.query_id AND l.db_id = b.db_id AND l.diagonal = b.diagonal
     AND l.i <= b.i AND l.before = b.floor_sum GROUP BY ALL)
"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    queries = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return queries, _documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_SEEDS_SQL} SELECT query_id, db_id, diagonal, seeds FROM seeds")
def kmer_seed_join(spark, sf):
    queries, documents = _sides(spark, sf)
    found = similarity.seeds(queries, documents, "id", "text", size=WORD)
    return found.withColumn("diagonal", F.col("diagonal").cast("long"))


def _gathered(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Turns as blocks, gathered together with a file that holds none; manifest and folder."""
    source, foreign, out = (scratch_path(spark, f"gather-{c}") for c in ("in", "foreign", "out"))
    line = F.concat_ws(" ", "conv_id", "turn", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    turns = tables.table(spark, sf, "conversations").select(F.concat(line, F.lit("\n")).alias("payload"))
    blocks.write_blocks(turns, source)
    names = tables.table(spark, sf, "region").coalesce(1).select(  # five rows
        F.lit(0).alias("stream"), F.col("r_regionkey").alias("voffset"), F.encode("r_name", "UTF-8").alias("payload")
    )
    blocks.write_chunks(names, foreign)
    return blocks.gather_blocks(spark, [source, f"{foreign}/*.out"], out, part_bytes=4 << 20), out


@query("""
SELECT 'blocks' AS kind, count(*) AS blocks, CAST(0 AS BIGINT) AS failed FROM conversations
UNION ALL SELECT 'foreign', 0, 1
""")
def gather_manifest(spark, sf):
    """Blocks gathered and files that failed, by the manifest of the gathering."""
    manifest, _ = _gathered(spark, sf)
    kind = F.when(F.col("file").endswith(".out"), "foreign").otherwise("blocks")
    return manifest.groupBy(kind.alias("kind")).agg(F.sum("blocks").alias("blocks"), F.sum("failed").alias("failed"))


@query("""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5(coalesce(text, '')) AS digest FROM conversations
""")
def gather_lines(spark, sf):
    """All turns, read from the numbered parts of a gathering that met a damaged file."""
    _, out = _gathered(spark, sf)
    parts = spark.read.option("pathGlobFilter", "part-*").text(out)
    fields = F.split("value", " ")
    return parts.select(fields[0].cast("long").alias("conv_id"), fields[1].cast("long").alias("turn"), fields[2].alias("digest"))


# Formatted collections and masks -------------------------------------------------


def _collection(spark: SparkSession, sf: str) -> collection.Collection:
    """All documents in seven volumes of about equal letters, named by number and source."""
    names = F.array(F.concat(F.lit("doc"), F.col("doc_id")), F.col("source"))
    path = scratch_path(spark, "collection")
    documents = _documents(spark, sf).withColumn("names", names)
    return collection.write_collection(documents, path, id_column="doc_id", text="text", names="names", volumes=7)


_LETTERS_SQL = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
_VOLUMES_SQL = f"""
l AS (SELECT *, {_LETTERS_SQL} AS s, length({_LETTERS_SQL}) AS n FROM documents),
v AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position,
  CAST(floor((sum(n) OVER (ORDER BY doc_id) - n) / greatest(1, ceil((SELECT sum(n) FROM l) / 7))) AS INTEGER) AS volume FROM l)
"""


@query(f"""
WITH {_VOLUMES_SQL} SELECT volume, count(*) AS records, CAST(sum(n) AS BIGINT) AS letters, max(n) AS longest,
  min(position) AS first_position, max(position) AS last_position FROM v GROUP BY volume
""")
def collection_volumes(spark, sf):
    """Documents formatted into volumes by their running sum of letters."""
    return _collection(spark, sf).volumes


@query(f"""
WITH {_VOLUMES_SQL} SELECT doc_id AS id, volume, substr(s, 11, 50) AS sequence FROM v
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND (volume IN (0, 2) OR volume = 5 AND lang = 'en') AND source <> 'src0'
""")
def collection_fetch(spark, sf):
    """Batch retrieval through an alias of volumes and of an alias, both with id lists."""
    stored, documents = _collection(spark, sf), _documents(spark, sf)
    stored.write_alias("english", [5], ids=documents.where("lang = 'en'").select("doc_id"))
    stored.write_alias("chosen", [0, 2, "english"], ids=documents.where("source <> 'src0'").select("doc_id"))
    good = tables.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    sequence = RES.subsequence(TXT.letters(F.coalesce("text", F.lit(""))), 11, 60)
    return stored.fetch(good, "chosen").select(F.col("doc_id").alias("id"), "volume", sequence.alias("sequence"))


@query("""
SELECT 'src3' AS name, doc_id FROM documents WHERE source = 'src3'
UNION ALL SELECT 'doc17', doc_id FROM documents WHERE doc_id = 17
""")
def collection_lookup(spark, sf):
    """Records by name: a source, which many records share, and a number."""
    return _collection(spark, sf).lookup(["src3", "doc17", "absent"])


_COMPLEXITY_SQL = f"""
x AS (SELECT doc_id AS id, unnest(string_split(s, '')) AS c, unnest(generate_series(0, length(s) - 1)) AS pos
  FROM (SELECT doc_id, {_LETTERS_SQL} AS s FROM documents) WHERE s <> ''),
p AS (SELECT id, pos, count(*) OVER (PARTITION BY id, c ORDER BY pos RANGE BETWEEN 11 PRECEDING AND 1 PRECEDING) AS back,
  count(*) OVER (PARTITION BY id, c ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS ahead FROM x),
g AS (SELECT id, pos, back - coalesce(lag(ahead, 12) OVER (PARTITION BY id ORDER BY pos), 0) AS gain FROM p),
h AS (SELECT id, pos, sum(gain) OVER (PARTITION BY id ORDER BY pos) AS pairs FROM g),
k AS (SELECT id, pos - 11 AS a, CASE WHEN pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) <= 12 THEN 0 ELSE 1 END AS fresh
  FROM h WHERE pos >= 11 AND pairs >= 14),
r AS (SELECT id, a, sum(fresh) OVER (PARTITION BY id ORDER BY a) AS run FROM k),
masks AS (SELECT id, min(a) AS start, max(a) + 12 AS stop FROM r GROUP BY id, run)
"""


@query(f"WITH {_COMPLEXITY_SQL} SELECT * FROM masks")
def low_complexity_masks(spark, sf):
    """Intervals of documents in which twelve letters hold fourteen or more equal pairs."""
    return masking.low_complexity(_documents(spark, sf), "doc_id", "text", window=12, least=14)


@query(f"""
WITH {_seeds_sql(WORD, 1)}, {_COMPLEXITY_SQL},
met AS (SELECT query_id, db_id, dw.i - qw.i AS diagonal, dw.i - 1 AS pos FROM dw JOIN qw USING (word))
SELECT query_id, db_id, CAST(diagonal AS BIGINT) AS diagonal, count(*) AS seeds FROM met
WHERE NOT EXISTS (SELECT 1 FROM masks WHERE id = db_id AND start < pos + {WORD} AND stop > pos)
GROUP BY ALL HAVING count(*) >= 2
""")
def masked_seeds(spark, sf):
    """Seeds of the benchmark outside the masks stored with the collection."""
    stored = _collection(spark, sf)
    stored.add_mask("low", masking.low_complexity(stored.records, "doc_id", "text", window=12, least=14))
    queries = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    records = stored.records.select(F.col("doc_id").alias("id"), "text")
    found = similarity.seeds(queries, records, "id", "text", size=WORD, mask=stored.masks("low"))
    return found.withColumn("diagonal", F.col("diagonal").cast("long"))


@query(f"""
WITH {_SEEDS_SQL}, {_ungapped_sql("q", "d", 5, -4)}
SELECT query_id, db_id, diagonal, seeds, score, q_from, q_to, CAST(q_from + diagonal AS BIGINT) AS d_from,
  CAST(q_to + diagonal AS BIGINT) AS d_to FROM hits
""")
def ungapped_hits(spark, sf):
    queries, documents = _sides(spark, sf)
    found = similarity.seeds(queries, documents, "id", "text", size=WORD)
    flat = similarity.extend_ungapped(found, queries, documents, "id", "text", similarity.Scoring())
    wide = [F.col(c).cast("long").alias(c) for c in ("diagonal", "q_from", "q_to", "d_from", "d_to")]
    return flat.select("query_id", "db_id", "seeds", "score", *wide)


# Fitted once by similarity.fit_statistics for 26 equally frequent letters.
SEARCH_SCORING = similarity.Scoring(match=5, mismatch=-4, gap_open=11, gap_extend=1, lam=0.5725, kappa=0.0727)


@query(f"""
WITH RECURSIVE {_SEEDS_SQL},
pair AS MATERIALIZED (SELECT query_id, db_id, q.s AS qs, d.s AS ds, length(q.s) AS q_len, length(d.s) AS d_len
  FROM (SELECT DISTINCT query_id, db_id FROM seeds) JOIN q USING (query_id) JOIN d USING (db_id)),
-- One table row per residue of the query: h is the best score that ends at (i, j), down that of an open gap.
cell(query_id, db_id, i, j, h, down) AS (
  SELECT query_id, db_id, 0, j, 0, -1000000 FROM pair, unnest(range(0, d_len + 1)) AS t(j)
  UNION ALL
  SELECT query_id, db_id, i, j, greatest(fresh, coalesce(max(fresh + j) OVER (
      PARTITION BY query_id, db_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - j - 11, 0)), down
  FROM (
    SELECT query_id, db_id, i, j, down, greatest(0, down, CASE WHEN j > 0 THEN diagonal + gain ELSE 0 END) AS fresh
    FROM (
      SELECT c.query_id, c.db_id, c.i + 1 AS i, c.j, greatest(c.down - 1, c.h - 12) AS down,
        lag(c.h) OVER (PARTITION BY c.query_id, c.db_id ORDER BY c.j) AS diagonal,
        CASE WHEN substr(qs, c.i + 1, 1) = substr(ds, c.j, 1) THEN 5 ELSE -4 END AS gain
      FROM cell c JOIN pair p ON p.query_id = c.query_id AND p.db_id = c.db_id WHERE c.i < p.q_len
    )
  )
),
best AS (SELECT query_id, db_id, max(h) AS score FROM cell GROUP BY ALL),
total AS (SELECT sum(length(s)) AS letters FROM d),
scored AS (SELECT query_id, db_id, CAST(q_len AS INTEGER) AS q_len, CAST(d_len AS INTEGER) AS d_len,
    CAST(score AS BIGINT) AS score, 0.0727e0 * q_len * letters * exp(-0.5725e0 * score) AS e
  FROM best JOIN pair USING (query_id, db_id), total)
SELECT query_id, db_id, q_len, d_len, score, round((0.5725e0 * score - ln(0.0727e0)) / ln(2e0), 6) AS bits, round(e, 6) AS evalue
FROM scored WHERE e <= 10
""")
def search_hits(spark, sf):
    """Best gapped score of every query and document that share words, with bits and e-value."""
    best = _segments(spark, sf).where("segment = 1")
    rounded = [F.round(c, 6).alias(c) for c in ("bits", "evalue")]
    return best.select("query_id", "db_id", "q_len", "d_len", "score", *rounded)


@query()
def search_segments(spark, sf):
    """All segments of the search with their alignments (the tests rescore them)."""
    return _segments(spark, sf)


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    queries, documents = _sides(spark, sf)
    return similarity.search(queries, documents, "id", "text", size=WORD, scoring=SEARCH_SCORING)


# Words of six letters, eleven of them on a diagonal: no segment that scores 16 has fewer.
SCREEN_WORD, SCREEN_SEEDS = 6, 11


# Each step finds the best stretch of every open region and opens what lies on both sides of it.
@query(f"""
WITH RECURSIVE {_seeds_sql(SCREEN_WORD, SCREEN_SEEDS)},
gain AS MATERIALIZED (SELECT query_id, db_id, diagonal, i, length(qs) AS q_len, length(ds) AS d_len,
    CASE WHEN substr(qs, i, 1) = substr(ds, i + diagonal, 1) THEN 1 ELSE -5 END AS g
  FROM (SELECT query_id, db_id, diagonal, q.s AS qs, d.s AS ds,
      unnest(generate_series(greatest(1, 1 - diagonal), least(length(q.s), length(d.s) - diagonal))) AS i
    FROM seeds JOIN q USING (query_id) JOIN d USING (db_id))),
region(query_id, db_id, diagonal, lo, hi, score, a, b) AS (
  SELECT query_id, db_id, diagonal, min(i), max(i), CAST(0 AS HUGEINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM gain GROUP BY ALL
  UNION ALL
  SELECT query_id, db_id, diagonal, CASE side WHEN 0 THEN lo ELSE b + 1 END, CASE side WHEN 0 THEN a - 1 ELSE hi END, score, a, b
  FROM (
    SELECT query_id, db_id, diagonal, lo, hi, score, b, list_max(list_filter(starts, lambda x: x <= b)) AS a
    FROM (
      SELECT *, list(i) FILTER (before = low) OVER (PARTITION BY query_id, db_id, diagonal, lo, low) AS starts, i AS b
      FROM (
        SELECT *, min(before) OVER (PARTITION BY query_id, db_id, diagonal, lo ORDER BY i) AS low,
          upto - min(before) OVER (PARTITION BY query_id, db_id, diagonal, lo ORDER BY i) AS score
        FROM (
          SELECT query_id, db_id, diagonal, lo, hi, i, sum(g) OVER w AS upto, sum(g) OVER w - g AS before
          FROM (SELECT query_id, db_id, diagonal, lo, hi FROM region WHERE lo <= hi) JOIN gain USING (query_id, db_id, diagonal)
          WHERE i BETWEEN lo AND hi
          WINDOW w AS (PARTITION BY query_id, db_id, diagonal, lo ORDER BY i)
        )
      )
    )
    QUALIFY row_number() OVER (PARTITION BY query_id, db_id, diagonal, lo ORDER BY score DESC, i) = 1
  ), (VALUES (0), (1)) AS t(side)
  WHERE score >= 16
),
placed AS (SELECT DISTINCT db_id, query_id, a + diagonal AS a, b + diagonal AS b, length(d.s) AS d_len, CAST(score AS BIGINT) AS score
  FROM region JOIN d USING (db_id) WHERE score >= 16),
ends AS (SELECT *, (a <= 25 OR b > d_len - 25) AS at_end FROM placed),
graded AS (SELECT *, CASE WHEN score >= CASE WHEN at_end THEN 24 ELSE 30 END THEN 'strong'
  WHEN score >= CASE WHEN at_end THEN 19 ELSE 25 END THEN 'moderate'
  WHEN score >= CASE WHEN at_end THEN 16 ELSE 23 END THEN 'weak' END AS strength FROM ends)
SELECT db_id AS record_id, query_id AS contaminant_id, CAST(a AS BIGINT) AS q_from, CAST(b AS BIGINT) AS q_to, score, strength
FROM graded WHERE strength IS NOT NULL
""")
def screen_segments(spark, sf):
    """Documents screened for passages of the benchmark: every segment of every diagonal."""
    queries, documents = _sides(spark, sf)
    found = similarity.screen(documents, queries, "id", "text", size=SCREEN_WORD, min_seeds=SCREEN_SEEDS)
    return found.withColumns({c: F.col(c).cast("long") for c in ("q_from", "q_to")})


@query(f"""
WITH {_SEEDS_SQL}, {_ungapped_sql("q", "d", 4, -1)}
SELECT query_id AS profile_id, db_id, diagonal, score FROM hits
""")
def profile_diagonals(spark, sf):
    """Every benchmark passage as a profile, along the diagonals of its own words."""
    queries, documents = _sides(spark, sf)
    consensus = TXT.letters("text")
    scores = F.transform(F.split(consensus, ""), lambda c: F.create_map(c, F.lit(4)))
    profiles = queries.select(F.col("id").alias("profile_id"), consensus.alias("consensus"), scores.alias("scores"))
    found = similarity.profile_diagonals(profiles, documents, "id", "text", size=WORD)
    return found.select("profile_id", "db_id", F.col("diagonal").cast("long"), F.col("score").cast("long"))


FAMILY_COLUMNS = 10
# Score of a letter by its share of a column: one in so many at least.
FAMILY_SCORES = {2: 6, 4: 4, 8: 2, 20: 0}
FAMILY_OTHER = -3
PROFILE_STATISTICS = {"lam": 0.35, "kappa": 0.1}


def _family_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(profile_id, scores): per last word of part names, the letters of names aligned at their ends."""
    names = tables.table(spark, sf, "part").select(TXT.letters("p_name").alias("s"), F.upper(F.regexp_extract("p_name", "([A-Za-z]+)[^A-Za-z]*$", 1)).alias("profile_id"))
    tail = F.split(F.reverse(F.right("s", F.lit(FAMILY_COLUMNS))), "")
    cells = names.where("profile_id <> ''").select("profile_id", F.posexplode(tail).alias("back", "letter")).groupBy("profile_id", "back", "letter").count()
    share, score = F.col("total"), F.lit(FAMILY_OTHER)
    for least, value in reversed(FAMILY_SCORES.items()):
        score = F.when(F.col("count") * least >= share, value).otherwise(score)
    totals = cells.groupBy("profile_id", "back").agg(F.sum("count").alias("total"))
    scored = cells.join(totals, ["profile_id", "back"]).select("profile_id", "back", "letter", score.alias("score"))
    columns = scored.groupBy("profile_id", "back").agg(F.map_from_entries(F.collect_list(F.struct("letter", "score"))).alias("column"))
    placed = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.map_entries("column").alias("column"))))
    grouped = columns.groupBy("profile_id").agg(placed.alias("columns"))
    return grouped.select("profile_id", F.transform("columns", lambda c: F.map_from_entries(c["column"])).alias("scores"))


_FAMILY_SQL = f"""
part_name AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s,
  upper(regexp_extract(p_name, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS family FROM part),
letter AS (SELECT family, back, substr(reverse(s), CAST(back AS INT), 1) AS letter, count(*) AS n
  FROM part_name, unnest(range(1, least(length(s), {FAMILY_COLUMNS}) + 1)) AS t(back) WHERE family <> '' GROUP BY ALL),
scored AS (SELECT family, max(back) OVER (PARTITION BY family) - back + 1 AS i, letter, CASE
  {" ".join(f"WHEN n * {k} >= sum(n) OVER (PARTITION BY family, back) THEN {v}" for k, v in FAMILY_SCORES.items())}
  ELSE {FAMILY_OTHER} END AS score FROM letter),
profile AS (SELECT family, max(i) AS columns FROM scored GROUP BY family)
"""


# Every family against every name, cell by cell and without any seed; names that are alike are aligned once.
@query(f"""
WITH RECURSIVE {_FAMILY_SQL},
name AS MATERIALIZED (SELECT s, length(s) AS d_len FROM part_name GROUP BY s),
gain AS MATERIALIZED (SELECT family, i, map(list(letter), list(score)) AS scores FROM scored GROUP BY ALL),
cell(family, s, i, j, h, down) AS (
  SELECT family, s, 0, j, 0, -1000000 FROM profile, name, unnest(range(0, d_len + 1)) AS t(j)
  UNION ALL
  SELECT family, s, i, j, greatest(fresh, coalesce(max(fresh + j) OVER (
      PARTITION BY family, s ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - j - 11, 0)), down
  FROM (
    SELECT family, s, i, j, down, greatest(0, down, CASE WHEN j > 0 THEN diagonal + gain ELSE 0 END) AS fresh
    FROM (
      SELECT c.family, c.s, CAST(c.i + 1 AS INT) AS i, c.j, greatest(c.down - 1, c.h - 12) AS down,
        lag(c.h) OVER (PARTITION BY c.family, c.s ORDER BY c.j) AS diagonal,
        coalesce(g.scores[substr(c.s, CAST(c.j AS INT), 1)], {FAMILY_OTHER}) AS gain
      FROM cell c JOIN gain g ON g.family = c.family AND g.i = c.i + 1
    )
  )
),
best AS (SELECT family, s, max(h) AS score FROM cell GROUP BY ALL),
total AS (SELECT sum(length(s)) AS letters FROM part_name),
hit AS (SELECT family, s, CAST(score AS BIGINT) AS score, {PROFILE_STATISTICS["kappa"]}e0 * letters * columns * exp(-{PROFILE_STATISTICS["lam"]}e0 * score) AS e
  FROM best JOIN profile USING (family), total)
SELECT family AS profile_id, p_partkey AS db_id, score, round(e, 6) AS evalue FROM hit JOIN part_name USING (s) WHERE e <= 10
""".replace("FROM hit JOIN part_name USING (s)", "FROM hit JOIN (SELECT p_partkey, s FROM part_name) USING (s)"))
def profile_search(spark, sf):
    """Families of part names as position-specific profiles, searched with gaps in all part names."""
    names = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    hits = similarity.profile_search(_family_profiles(spark, sf), names, "id", "text", other=FAMILY_OTHER, **PROFILE_STATISTICS)
    return hits.select("profile_id", "db_id", "score", F.round("evalue", 6).alias("evalue"))


@query(f"""
WITH RECURSIVE {_SEEDS_SQL},
edges AS (SELECT DISTINCT -1 - query_id AS a, db_id AS b FROM seeds),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
ids AS (SELECT doc_id AS id FROM documents UNION ALL SELECT -1 - item_id FROM benchmark),
reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT id, min(other) AS cluster FROM reach GROUP BY id
""")
def single_linkage(spark, sf):
    """Documents clustered through the passages they share."""
    queries, documents = _sides(spark, sf)
    found = similarity.seeds(queries, documents, "id", "text", size=WORD)
    pairs = found.select((-1 - F.col("query_id")).alias("a"), F.col("db_id").alias("b")).distinct()
    ids = documents.select("id").unionAll(queries.select(-1 - F.col("id")))
    return clustering.single_linkage(ids, pairs)


# Reports -----------------------------------------------------------------------


def _report_path(spark: SparkSession, sf: str) -> str:
    """One report document per conversation turn, as XML text in turn order."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>\n"))
    size = F.length("text")
    hseq = TXT.letters("text")

    def segment(evalue: Column, q_to: Column, seq: Column) -> Column:
        return F.concat(
            F.lit("<Hsp>\n"),
            tag("Hsp_evalue", evalue),
            tag("Hsp_query-from", F.lit(1)),
            tag("Hsp_query-to", q_to),
            tag("Hsp_hit-from", F.col("turn") + 1),
            tag("Hsp_hit-to", F.col("turn") + q_to),
            tag("Hsp_hseq", seq),
            F.lit("</Hsp>\n"),
        )

    hit = F.concat(
        F.lit("<Hit>\n"),
        tag("Hit_id", F.concat(F.lit("gi|"), "turn", F.lit("|"), "role", F.lit("|"))),
        tag("Hit_def", esc(F.concat(F.lit("turn ["), "role", F.lit("]")))),
        F.lit("<Hit_hsps>\n"),
        segment(F.lit("1e-30"), F.lit(5), F.lit("MKV-L")),
        segment(F.when(size > 300, "1e-05").otherwise("0.5"), size, hseq),
        F.lit("</Hit_hsps>\n</Hit>\n"),
    )
    document = F.concat(
        F.lit(xml.XML_HEAD + "\n<BlastOutput>\n"),
        tag("BlastOutput_query-def", F.concat(F.lit("conv "), "conv_id")),
        F.lit("  <BlastOutput_iterations>\n<Iteration>\n"),
        tag("Iteration_iter-num", F.lit(1)),
        tag("Iteration_query-def", F.concat(F.lit("gi|"), "conv_id", F.lit("| conversation"))),
        F.lit("<Iteration_hits>\n"),
        hit,
        F.lit("</Iteration_hits>\n</Iteration>\n  </BlastOutput_iterations>\n</BlastOutput>"),
    )
    path = scratch_path(spark, "reports")
    _turns(spark, sf).orderBy("seq").select(document.alias("value")).write.text(path)
    return path


_TURN_SQL = "(SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)"


_TAB_HITS_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(turn AS VARCHAR) AS hit_id, 1 AS q_from,
  CAST(length(text) AS INTEGER) AS q_to, CAST(turn + 1 AS INTEGER) AS h_from, CAST(turn + length(text) AS INTEGER) AS h_to,
  CAST(0.00001 AS DOUBLE) AS evalue, role AS organism
FROM conversations WHERE length(text) > 300
"""


@query(_TAB_HITS_SQL)
def report_tab_hits(spark, sf):
    documents = xml.read_documents(spark, _report_path(spark, sf))
    parsed = xml.parse_documents(documents, xml.TAB_REPORT_SCHEMA)
    return rep.tab_hits(parsed).drop("doc", "iter", "hit_no")


@query(_TAB_HITS_SQL)
def report_tab_hits_merged(spark, sf):
    """Hit table of one merged report, read by iteration."""
    path = scratch_path(spark, "merged")
    merged = rep.merge_reports(xml.read_documents(spark, _report_path(spark, sf)))
    merged.orderBy("line_no").select("value").write.text(path)
    return rep.tab_hits(xml.read_iterations(spark, path, xml.TAB_ITERATION_SCHEMA)).drop("doc", "iter", "hit_no")


@query("""
SELECT 'turn [' || role || ']' AS header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM conversations
""")
def report_hit_sequences(spark, sf):
    parsed = xml.parse_documents(xml.read_documents(spark, _report_path(spark, sf)))
    return rep.hit_sequences(parsed).select("header", "sequence")


@query(f"""
SELECT n AS iter_num, 'gi|' || conv_id || '| conversation' AS query_def, 2 AS segments FROM {_TURN_SQL}
""")
def report_merge(spark, sf):
    """All reports merged into one document, written, and read back by iteration."""
    documents = xml.read_documents(spark, _report_path(spark, sf))
    path = scratch_path(spark, "merged")
    merged = rep.merge_reports(documents)
    merged.orderBy("line_no").select("value").write.text(path)
    found = xml.read_iterations(spark, path)
    return found.select(
        F.col("`Iteration_iter-num`").cast("long").alias("iter_num"),
        F.col("`Iteration_query-def`").alias("query_def"),
        F.size(F.col("Iteration_hits.Hit")[0]["Hit_hsps"]["Hsp"]).alias("segments"),
    )


# Readers and listings over files made from the tables --------------------------


def _fasta_text(spark: SparkSession, sf: str, breaks: str = "\n") -> str:
    """Documents as FASTA lines; letters only, so that no ``>`` stands in a body."""
    path = scratch_path(spark, "fasta")
    record = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(f" x{breaks}"), F.coalesce(TXT.letters("text"), F.lit("")))
    rows = _documents(spark, sf).select(record.alias("value"))
    rows.write.option("lineSep", breaks).text(path)
    return path


_FASTA_RECORDS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS BIGINT) AS letters
FROM documents
"""


@query(_FASTA_RECORDS_SQL)
def fasta_any_gt(spark, sf):
    """Records cut at every ``>``."""
    found = delimited.read_fasta(spark, _fasta_text(spark, sf), any_gt=True)
    return found.select(F.split_part("header", F.lit(" "), F.lit(1)).alias("id"), TXT.letter_count("body").cast("long").alias("letters"))


@query(_FASTA_RECORDS_SQL)
def fasta_any_break(spark, sf):
    """Records of files whose lines end in CR LF."""
    found = delimited.read_fasta(spark, _fasta_text(spark, sf, "\r\n"))
    raw = delimited.normalize_breaks("raw")
    header = F.split_part(F.substring_index(raw, "\n", 1), F.lit(" "), F.lit(1))
    body = F.substr(raw, F.instr(raw, "\n") + 1)
    return found.select(F.substr(header, F.lit(2)).alias("id"), F.length(F.regexp_replace(body, "[^A-Za-z]", "")).cast("long").alias("letters"))


@query("SELECT count(*) AS records FROM documents")
def record_count(spark, sf):
    return spark.range(1).select(F.lit(delimited.count_records(spark, _fasta_text(spark, sf))).cast("long").alias("records"))


@query("""
SELECT row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS entry, role, 'CRC!' AS mark,
  CAST(strlen(text) AS BIGINT) AS size FROM conversations
""")
def chunk_index_marks(spark, sf):
    """Index listing with the mark of every entry, numbered over the files of a role."""
    turns = _turns(spark, sf).select("role", "seq", F.encode("text", "UTF-8").alias("payload"))
    numbers = turns.select("role").distinct().orderBy("role").collect()  # a few roles
    listed = None
    for stream, row in enumerate(numbers):
        path = scratch_path(spark, "marks")
        rows = turns.where(F.col("role") == row["role"]).select(
            F.lit(stream).alias("stream"), F.col("seq").alias("voffset"), "payload"
        )
        blocks.write_chunks(rows, path)
        index = blocks.read_index_marks(spark, path, glob="*.idx").select("voffset", "mark", "size")
        part = ordinal(index, "voffset", "entry").select("entry", F.lit(row["role"]).alias("role"), "mark", "size")
        listed = part if listed is None else listed.unionAll(part)
    return listed


@query("SELECT n_name AS key, count(*) AS rows, CAST(sum(c_acctbal > 0) AS BIGINT) AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def tab_file_round_trip(spark, sf):
    """Rows written as tab-separated text and read back."""
    path = scratch_path(spark, "tab")
    rows = tables.table(spark, sf, "customer").join(
        tables.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    writers.write_tab(rows.select("n_name", "c_custkey", "c_acctbal"), path)
    found = spark.read.option("sep", "\t").schema("key STRING, id BIGINT, balance DOUBLE").csv(path)
    return found.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("balance") > 0).alias("positive"))


# Programs and streams ----------------------------------------------------------


@query(CHECKS["record_lengths"])
def stream_available(spark, sf):
    """The length report as a stream that takes what is there and stops."""
    schema = _documents(spark, sf).schema
    feed = parquet_feed(spark, f"{sf}/documents*.parquet", schema)
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    report = lambda df: records.length_report(df, "doc_id", TXT.letter_count("text").cast("long"))
    run_available(feed, report, out, state)
    return spark.read.schema("id BIGINT, length BIGINT").parquet(out)


def _streamed_windows(spark: SparkSession, sf: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All events through a stream that is stopped, taken up again and closed."""
    path = f"{sf}/events*.parquet"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    closing, out, state = (scratch_path(spark, f"windows-{c}") for c in ("closing", "out", "state"))

    def shaped(feed: DataFrame) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long").alias("cents")
        return transform(feed.select(F.timestamp_micros(timelines.wall_micros("ts")).alias("at"), "user_id", "event_type", cents))

    feed = lambda: windows.closable_feed(spark, path, closing, schema)
    windows.run_windows(spark, feed, shaped, out, state)
    windows.close(spark, closing, schema, "ts")
    windows.run_windows(spark, feed, shaped, out, state)
    return spark.read.parquet(out)


@query("""
SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, epoch_us(date_trunc('hour', ts)) + 3600000000 AS end_us,
  count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM events WHERE ts IS NOT NULL GROUP BY ALL
""")
def stream_tumbling_windows(spark, sf):
    """Events of each kind and hour, counted by a stream with a watermark."""
    totals = [F.count("*").alias("n"), F.sum("cents").alias("cents")]
    return _streamed_windows(spark, sf, lambda feed: windows.tumbling(feed, "at", "1 hour", "1 day", ["event_type"], totals))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS k FROM m)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents
FROM s GROUP BY user_id, k
""")
def stream_session_windows(spark, sf):
    """Sessions of each user, ended by six quiet hours, built by a stream with a watermark."""
    totals = [F.count("*").alias("n"), F.sum("cents").alias("cents")]
    return _streamed_windows(spark, sf, lambda feed: windows.sessions(feed, "at", "6 hours", "1 day", ["user_id"], totals))
