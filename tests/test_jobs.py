import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.operators import clustering, external, provenance, recovery, reports, retrieval, timelines
from recordmill.sources import blocks, delimited, joblogs, tables, writers
from recordmill.sources import reports as xml
from recordmill.streaming import run_available, run_for
from recordmill.streaming.feeds import fasta_feed, parquet_feed

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_block_log(spark, tmp_path):
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / "log").write_text("# c\nS\t0\nE3\t2\n")
    (tmp_path / "0" / "other").write_text("X\t9\n")
    log = joblogs.parse_block_log(joblogs.read_logs(spark, str(tmp_path)))
    ids = spark.createDataFrame([(i,) for i in range(4)], "block_id BIGINT")
    found = recovery.classify_blocks(ids, log)
    got = {r.block_id: r.outcome for r in found.collect()}
    assert got == {0: "success", 1: "resume", 2: "failed", 3: "resume"}
    assert {r.outcome: r.records for r in recovery.outcome_counts(found).collect()} == {"success": 1, "failed": 1, "resume": 2}
    assert recovery.split_outcomes(found)["failed"].count() == 1


@pytest.mark.parametrize("line", ["X\t1", "E\t2", "S 3"])
def test_block_log_malformed(spark, tmp_path, line):
    path = tmp_path / "log"
    path.write_text(line + "\n")
    lines = delimited.read_lines(spark, str(path))
    with pytest.raises(Exception, match="malformed log line"):
        joblogs.parse_block_log(lines).collect()
    assert joblogs.parse_block_log(lines, mode="permissive").first()._corrupt == line
    assert joblogs.parse_block_log(lines, mode="drop").count() == 0


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "a").write_text("S\t1\nE1\t1\nS\t2\n")
    (tmp_path / "b").write_text("E1\t2\n")
    log = joblogs.parse_block_log(delimited.read_lines(spark, str(tmp_path)))
    assert {r.block_id: r.status for r in recovery.last_status(log).collect()} == {1: "E", 2: "E"}


@quick
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=25), st.lists(st.tuples(st.sampled_from("SE"), st.sampled_from("abcd")), max_size=20))
def test_multiset_matches_loop(spark, keys, log):
    records = spark.createDataFrame([(i * 70_001, k) for i, k in enumerate(keys)], "pos BIGINT, key STRING")
    logged = spark.createDataFrame(log, "status STRING, key STRING")
    left = {"S": [k for s, k in log if s == "S"], "E": [k for s, k in log if s == "E"]}
    want = []
    for k in keys:
        for status, outcome in (("S", "success"), ("E", "failed")):
            if k in left[status]:
                left[status].remove(k)
                want.append(outcome)
                break
        else:
            want.append("resume")
    got = recovery.classify_records(records, "pos", "key", logged).orderBy("pos").collect()
    assert [r.outcome for r in got] == want


def test_timing_log(spark, tmp_path):
    path = tmp_path / "t"
    path.write_text(
        "noise\n[3] [TIMING] Slave 1, Worker 2 beginning search at 1.5.\n"
        "[3] [TIMING] Slave 1, Worker 2 done with search at 4.0.\n"
        "[3] [TIMING] Slave 1, Worker 2 beginning search at 5.0.\n"
        "[3] [TIMING] Slave 9, Worker 9 Requesting at 7.25.\n"
    )
    timing = joblogs.parse_timing_log(delimited.read_lines(spark, str(path)))
    begins, ends = F.col("event") == joblogs.TIMING_BEGIN, F.col("event") == joblogs.TIMING_DONE
    out = timelines.build_intervals(timing, "pos", ["slave", "worker"], begins, ends, "t").orderBy("t0").collect()
    assert [(r.t0, r.dur, r.closed) for r in out] == [(1.5, 2.5, True), (5.0, 2.25, False)]


@quick
@given(st.lists(st.sampled_from([1, -1]), min_size=1, max_size=30))
def test_intervals_match_stack(spark, signs):
    rows = [(i * 90_001, 1, float(i), s) for i, s in enumerate(signs)]
    df = spark.createDataFrame(rows, "pos BIGINT, w INT, t DOUBLE, s INT")
    out = timelines.build_intervals(df, "pos", ["w"], F.col("s") == 1, F.col("s") == -1, "t").collect()
    stack, want = [], {}
    for i, s in enumerate(signs):
        if s == 1:
            stack.append(i)
            want[float(i)] = (len(signs) - 1 - i, False)
        elif stack:
            begin = stack.pop()
            want[float(begin)] = (i - begin, True)
    assert {r.t0: (r.dur, r.closed) for r in out} == want


def test_growth_log(spark, tmp_path):
    error = "x ERROR:  Could not complete growth.\n"
    path = tmp_path / "g"
    path.write_text(error + "Molecule: ZINC123\n" + error + "other\n" + error)
    found = timelines.failed_molecules(joblogs.parse_growth_log(delimited.read_lines(spark, str(path))))
    assert [r.molecule for r in found.orderBy("pos").collect()] == ["None", "ZINC123", "ZINC123"]


def test_gather_golden(spark, tmp_path):
    (tmp_path / "w.out").write_bytes(b"BBAAACC" + b"z" * 5000)
    entries = [(1, 0, 0, 2), (0, 0, 2, 3), (1, 2, 5, 2), (2, 0, 7, 5000)]
    index = b"".join(struct.pack("<HQQQ4s", *e, b"CRC!") for e in entries)
    (tmp_path / "w.idx").write_bytes(index + b"partial")
    found = blocks.read_chunk_index(spark, str(tmp_path), glob="*.idx")
    rows = found.collect()
    assert sorted((r.stream, r.voffset, r.poffset, r.size) for r in rows) == sorted(entries)
    assert {r.mark for r in rows} == {"CRC!"} and sorted(r.entry for r in rows) == list(range(len(rows)))
    assert blocks.read_index_marks(spark, str(tmp_path), glob="*.idx").count() == 4
    chunks = provenance.order_chunks(provenance.gather(found)).collect()
    assert b"".join(bytes(r.payload) for r in chunks) == b"AAABBCC" + b"z" * 5000


def test_chunk_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 3, i, bytes(rng.randrange(256) for _ in range(rng.randrange(50)))) for i in range(200)]
    df = spark.createDataFrame(rows, "stream INT, voffset BIGINT, payload BINARY").repartition(4)
    path = str(tmp_path / "chunks")
    blocks.write_chunks(df, path)
    with pytest.raises(Exception, match="not empty"):
        blocks.write_chunks(df, path)
    blocks.write_chunks(df, path, force=True)
    back = provenance.gather(blocks.read_chunk_index(spark, path, glob="*.idx")).collect()
    assert sorted((r.stream, r.voffset, bytes(r.payload)) for r in back) == sorted(rows)
    assert not list((tmp_path / "chunks").glob(".attempt*"))


def test_blocks(spark, tmp_path):
    for version in (1, 2):
        df = spark.createDataFrame([(b"abc",), (b"",), (b"x" * 9000,)], "payload BINARY").coalesce(1)
        path = str(tmp_path / f"v{version}")
        blocks.write_blocks(df, path, version=version)
        back = blocks.read_blocks(spark, path, version=version).orderBy("block_id").collect()
        assert [bytes(r.payload) for r in back] == [b"abc", b"", b"x" * 9000]
    (part,) = (tmp_path / "v1").glob("*.blocks")
    index = blocks.read_block_index(blocks.list_files(spark, str(tmp_path / "v1")))
    assert blocks.block_counts(index).where("file IS NULL").first().blocks == 3
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(Exception, match="truncated block"):
        blocks.read_blocks(spark, str(part)).collect()
    good = zlib.compress(b"good")
    damaged = tmp_path / "damaged"
    damaged.write_bytes(struct.pack("<q", 4) + b"junk" + struct.pack("<q", len(good)) + good)
    found = blocks.read_blocks(spark, str(damaged), skip_bad=True).orderBy("block_id").collect()
    assert [bytes(r.payload) for r in found if r.error is None] == [b"good"]
    assert all(r.payload is None for r in found if r.error) and sum(r.error is not None for r in found) == 1
    with pytest.raises(Exception):
        blocks.read_blocks(spark, str(damaged)).collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("one")
    (tmp_path / "in" / "2").write_text("two")
    blocks.compress_files(spark, str(tmp_path / "in"), str(tmp_path / "packed"))
    assert {bytes(r.payload) for r in blocks.read_blocks(spark, str(tmp_path / "packed")).collect()} == {b"one", b"two"}


def segment(evalue, q_from, q_to, h_from, h_to, seq):
    return (
        f"<Hsp><Hsp_evalue>{evalue}</Hsp_evalue><Hsp_query-from>{q_from}</Hsp_query-from><Hsp_query-to>{q_to}</Hsp_query-to>"
        f"<Hsp_hit-from>{h_from}</Hsp_hit-from><Hsp_hit-to>{h_to}</Hsp_hit-to><Hsp_hseq>{seq}</Hsp_hseq></Hsp>"
    )


def hit(name, title, *segments):
    return f"<Hit>\n<Hit_id>{name}</Hit_id><Hit_def>{title}</Hit_def><Hit_hsps>{''.join(segments)}</Hit_hsps></Hit>\n"


def document(query, hits):
    return (
        '<?xml version="1.0"?>\n<!DOCTYPE BlastOutput PUBLIC "x" "y.dtd">\n<BlastOutput>\n'
        f"<BlastOutput_query-def>doc {query}</BlastOutput_query-def>\n  <BlastOutput_iterations>\n"
        f"<Iteration>\n<Iteration_iter-num>1</Iteration_iter-num>\n<Iteration_query-def>{query}</Iteration_query-def>\n"
        f"<Iteration_hits>{hits}</Iteration_hits></Iteration>\n  </BlastOutput_iterations>\n</BlastOutput>\n"
    )


@pytest.fixture
def report(tmp_path):
    first = document(
        "gi|11|ref|Q1| x",
        hit("gi|22|sp|P1|", "prot A [Homo sapiens]", segment("1e-10", 1, 10, 5, 14, "MKV-L"), segment("1e-5", 20, 25, 30, 35, "MKK"))
        + hit("lcl1", "no organism", segment("0.5", 1, 4, 1, 4, "AAAA")),
    )
    path = tmp_path / "report.xml"
    path.write_text(first + document("q2", ""))
    return str(path)


def test_report_hits(spark, report):
    parsed = xml.parse_documents(xml.read_documents(spark, report))
    (row,) = reports.tab_hits(parsed).collect()
    assert tuple(row)[3:] == ("11", "22", 20, 25, 30, 35, 1e-5, "Homo sapiens")
    assert reports.tab_hits(parsed, keep="best").first().q_from == 1
    assert reports.tab_hits(parsed, keep="all").count() == 2
    found = reports.hit_sequences(parsed).orderBy("doc", "hit_no").collect()
    assert [(r.header, r.sequence) for r in found] == [("prot A [Homo sapiens]", "MKK"), ("no organism", "AAAA")]
    with pytest.raises(ValueError):
        reports.hits(parsed, keep="first")


def test_write_tab(spark, report, tmp_path):
    parsed = xml.parse_documents(xml.read_documents(spark, report))
    writers.write_tab(reports.tab_hits(parsed, max_evalue=1.0).drop("doc", "iter", "hit_no"), str(tmp_path / "tab"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "tab")).collect()}
    assert lines == {"11\t22\t20\t25\t30\t35\t1.0E-5\tHomo sapiens", "11\t\t1\t4\t1\t4\t0.5\t"}


def test_report_bad_evalue(spark, tmp_path):
    path = tmp_path / "bad.xml"
    path.write_text(document("q", hit("a", "b", segment("often", 1, 1, 1, 1, "A"))))
    with pytest.raises(Exception, match="e-value is not a number"):
        reports.tab_hits(xml.parse_documents(xml.read_documents(spark, str(path)))).collect()


def test_report_merge(spark, report, tmp_path):
    merged = reports.merge_reports(xml.read_documents(spark, report)).orderBy("line_no")
    out = str(tmp_path / "merged")
    merged.select("value").write.text(out)
    text = "\n".join(r.value for r in merged.collect())
    assert text.count("<?xml") == 1 and text.count("<Iteration>") == 2 and text.count("</BlastOutput>") == 1
    back = xml.read_iterations(spark, out)
    assert [r[0] for r in back.select("`Iteration_iter-num`").collect()] == [1, 2]
    parsed = xml.parse_documents(xml.read_documents(spark, report))
    assert [r.iter_num for r in reports.renumber_iterations(parsed).orderBy("iter_num").collect()] == [1, 2]


def test_merged_parts(spark, report, tmp_path):
    """A merged document stored as several parts, the later ones without a head; a broken iteration fails."""
    out = str(tmp_path / "parts")
    merged = reports.merge_reports(xml.read_documents(spark, report)).coalesce(1).orderBy("line_no").select("value")
    lines = [r.value for r in merged.collect()]
    (tmp_path / "parts").mkdir()
    for k, part in enumerate([lines[:2], lines[2:2], lines[2:] + [lines[1].replace(">1<", ">3<")] * 2]):
        (tmp_path / "parts" / f"part-{k}").write_text("".join(f"{line}\n" for line in part))
    back = xml.read_iterations(spark, out)
    assert sorted(r[0] for r in back.select("`Iteration_iter-num`").collect()) == [1, 2, 3, 3]
    (tmp_path / "parts" / "part-4").write_text("<Iteration>\n<Iteration_iter-num>4</Iteration_iter-num>\n<Iteration_query-def>cut")
    with pytest.raises(Exception):
        xml.read_iterations(spark, out).collect()


def test_clusters(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 5)] + [(100, x) for x in range(101, 140)]
    rng.shuffle(pairs)
    ids = spark.createDataFrame([(i,) for i in [*range(45), *range(100, 140)]], "id BIGINT")
    got = {r.id: r.cluster for r in clustering.single_linkage(ids, spark.createDataFrame(pairs, "a BIGINT, b BIGINT")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[44] == 44 and {got[i] for i in range(100, 140)} == {100}
    hits = spark.createDataFrame(
        [(1, 2, 10, 10, 1, 10, 1, 10, 20.0, 10), (1, 3, 10, 30, 1, 10, 1, 10, 20.0, 10), (2, 3, 10, 10, 1, 10, 1, 10, 9.0, 5)],
        "query_id INT, db_id INT, q_len INT, d_len INT, q_from INT, q_to INT, d_from INT, d_to INT, bits DOUBLE, identities INT",
    )
    assert [tuple(r) for r in clustering.coverage_pairs(hits).collect()] == [(1, 2)]
    assert clustering.coverage_pairs(hits, both_sides=False).count() == 2
    assert clustering.coverage_pairs(hits, score=50).count() == 2


def test_external(spark, tmp_path):
    df = spark.createDataFrame([(0, "abc"), (1, "boom")], "pos BIGINT, s STRING")
    out = external.run_per_record(df, "pos", "s", ["sh", "-c", "read x; [ \"$x\" = boom ] && kill -9 $$; printf %s \"$x\""])
    got = {r.pos: (bytes(r.output), r.exit_code) for r in out.collect()}
    assert got == {0: (b"abc", 0), 1: (b"", -9)}
    (tmp_path / "shared.db").write_text("shared ")
    both = external.run_per_record(df, "pos", "s", ["cat", "shared.db", "-"], shared=[str(tmp_path / "shared.db")])
    assert {bytes(r.output) for r in both.collect()} == {b"shared abc", b"shared boom"}

    def parts(data):
        if data == b"boom":
            raise ValueError("boom")
        return [(len(data), data.decode())]

    found = external.call_per_record(df, "pos", "s", parts, "size INT, text STRING").orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(0, 3, "abc", None), (1, None, None, "ValueError: boom")]


def test_retrieval(spark):
    df = spark.createDataFrame([(1, "AACCGGTT"), (2, "ACGT")], "id INT, seq STRING")
    assert retrieval.fetch(df, [1], "id", "seq", start=2, stop=4, bottom_strand=True).first().sequence == "GGT"
    words = spark.createDataFrame([(1, "The cat"), (2, "breathe the air"), (3, "bathed")], "id INT, t STRING")
    assert [r.id for r in words.where(retrieval.has_term("t", "the")).collect()] == [1, 2]
    a, b = words.where("id < 3").select("id"), words.where("id > 1").select("id")
    assert retrieval.either(a, b).count() == 3 and retrieval.but_not(a, b).first().id == 1


def test_format_database(spark):
    df = spark.createDataFrame([(i, "MK") for i in range(50)], "id INT, sequence STRING")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS fmt LOCATION '{spark.conf.get('spark.checkpoint.dir')}/fmt'")
    tables.format_database(df, "fmt.seqs", buckets=4)
    assert spark.table("fmt.seqs").count() == 50
    with pytest.raises(ValueError, match="duplicate"):
        tables.format_database(df.unionAll(df), "fmt.twice")
    spark.sql("DROP DATABASE fmt CASCADE")


def test_streaming_resume(spark, tmp_path):
    feed_dir, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    spark.range(10).write.parquet(str(feed_dir))
    schema = spark.range(1).schema

    def run():
        run_available(parquet_feed(spark, str(feed_dir), schema), lambda df: df.withColumn("x", F.col("id") * 2), out, state)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == list(range(10))
    spark.range(10, 15).write.mode("append").parquet(str(feed_dir))
    assert run() == list(range(15))
    assert run() == list(range(15))


def test_streaming_fasta_and_limit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">a\nMK\n>b\nL\n")
    done = run_for(fasta_feed(spark, str(tmp_path / "in")), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"), 60)
    assert done and {r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {">a\nMK\n", ">b\nL\n"}
