import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.functions import text as T
from recordmill.operators import packing, records, sampling
from recordmill.plans.ordered import Running, following, ordinal, running
from recordmill.sources import delimited, writers

GOLDEN = b">a one\nMKV\nLL\n>b\nMK*-\n>c x\nMKVLL\n>d\nM K\n"
# Positions far apart: a handful of rows then spans many buckets and chunks.
STRIDE = 50_021

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def fasta(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fasta") / "golden.fasta"
    path.write_bytes(GOLDEN)
    found = delimited.read_fasta(spark, str(path))
    offsets = delimited.with_byte_offsets(found).select("file", "pos", "byte_off")
    lengths = found.select("*", T.residue_count("body").alias("n"), T.record_id("header").alias("id"))
    return lengths.join(offsets, ["file", "pos"])


def test_fasta_golden(fasta):
    rows = fasta.orderBy("pos").collect()
    assert [(r.pos, r.id, r.byte_off, r.byte_len, r.n) for r in rows] == [
        (0, "a", 0, 14, 5), (1, "b", 14, 8, 4), (2, "c", 22, 11, 5), (3, "d", 33, 7, 2)
    ]
    assert "".join(r.raw for r in rows).encode() == GOLDEN


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


def test_golden_operators(fasta):
    assert [r.id for r in records.sort_longest_first(fasta, "pos", "byte_len").collect()] == ["a", "c", "b", "d"]
    for splits, want in ((2, [0, 0, 1, 1]), (3, [0, 1, 1, 2])):
        parts = packing.byte_split(fasta, "pos", "byte_len", splits)
        assert [r.part for r in parts.orderBy("pos").collect()] == want
    for size, want in ((20, [0, 0, 1, 1]), (12, [0, 1, 1, 2])):
        parts = packing.greedy_pack(fasta, "pos", "byte_len", size)
        assert [r.block for r in parts.orderBy("pos").collect()] == want
    assert ids(sampling.credit_sample(fasta, "pos", "n", 2)) == ["a", "c"]
    assert ids(sampling.credit_sample_rest(fasta, "pos", "n", 2)) == ["b", "d"]
    assert ids(sampling.credit_sample(fasta, "pos", "n", 2, low=4)) == ["a", "c"]
    histogram = records.length_histogram(fasta, F.col("n")).orderBy("bin").collect()
    assert [(r.bin, r["count"], r.ratio) for r in histogram] == [(1, 1, 0.5), (3, 1, 0.5), (4, 2, 1.0)]
    assert ids(records.first_k_per_bin(fasta, "pos", "n", height=1, max_length=10)) == ["a"]


def test_reader_edges(spark, tmp_path):
    path = tmp_path / "edge.fasta"
    path.write_bytes(b"preamble\n>a >not a boundary\nMK\n>>odd\nL\n>empty\n>last\nV")
    rows = delimited.read_fasta(spark, str(path)).orderBy("pos").collect()
    assert [r.raw for r in rows] == ["preamble\n", ">a >not a boundary\nMK\n", ">>odd\nL\n", ">empty\n", ">last\nV"]
    assert [r.header for r in rows] == ["preamble", "a >not a boundary", ">odd", "empty", "last"]
    loose = delimited.read_fasta(spark, str(path), any_gt=True).orderBy("pos").collect()
    assert [r.header for r in loose][:3] == ["preamble", "a ", "not a boundary"]
    crlf = tmp_path / "crlf.fasta"
    crlf.write_bytes(b">a\r\nMK\r\n>b\r\nL\r\n")
    found = delimited.read_fasta(spark, str(crlf)).orderBy("pos")
    assert [(r.header, r.n) for r in found.select("header", T.letter_count("body").alias("n")).collect()] == [("a", 2), ("b", 1)]


def test_reader_small_splits(spark, tmp_path):
    rng = random.Random(5)
    whole = {}
    for name in ("b.fasta", "a.fasta"):
        parts = [f">{name}{i} x\n" + "\n".join("M" * rng.randint(0, 70) for _ in range(3)) + "\n" for i in range(300)]
        (tmp_path / name).write_text("".join(parts))
        whole[name] = parts
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = delimited.with_byte_offsets(delimited.read_fasta(spark, str(tmp_path)))
        rows = delimited.read_fasta(spark, str(tmp_path)).orderBy("pos").collect()
        offsets = [r.byte_off for r in found.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = whole["a.fasta"] + whole["b.fasta"]
    assert [r.raw for r in rows] == want and [r.pos for r in rows] == list(range(600))
    starts = []
    for parts in (whole["a.fasta"], whole["b.fasta"]):
        at = 0
        for p in parts:
            starts.append(at)
            at += len(p)
    assert offsets == starts


@quick
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 9) | st.none()), min_size=1, max_size=40), st.booleans())
def test_running_matches_loop(spark, rows, descending):
    df = spark.createDataFrame([(i * STRIDE, k, v) for i, (k, v) in enumerate(rows)], "pos BIGINT, k STRING, v INT")
    specs = [
        Running("total", F.col("v"), total="all"),
        Running("before", F.col("v"), exclusive=True),
        Running("low", F.col("v"), "min"),
        Running("high", F.col("v"), "max", exclusive=True),
        Running("last", F.col("v"), "last"),
    ]
    out = running(df, "pos", specs, within=["k"], descending=descending)
    got = {r.pos: (r.total, r.before, r.low, r.high, r.last) for r in out.collect()}
    seen: dict[str, list] = {}
    order = list(enumerate(rows))
    for i, (k, v) in reversed(order) if descending else order:
        past = [x for x in seen.setdefault(k, []) if x is not None]
        seen[k].append(v)
        now = [x for x in seen[k] if x is not None]
        want = (sum(now), sum(past), min(now, default=None), max(past, default=None), now[-1] if now else None)
        assert got[i * STRIDE] == want


def test_ordinal_and_following(spark):
    df = spark.createDataFrame([(i * STRIDE, i % 2) for i in range(20)], "pos BIGINT, k INT")
    assert [r.ordinal for r in ordinal(df, "pos").orderBy("pos").collect()] == list(range(20))
    after = following(df, "pos", "next", F.col("pos"), within=["k"]).orderBy("pos").collect()
    assert [r.next for r in after] == [(i + 2) * STRIDE if i < 18 else None for i in range(20)]


@quick
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.integers(1, 150))
def test_greedy_pack_matches_loop(spark, lens, threshold):
    df = spark.createDataFrame([(i * STRIDE, n) for i, n in enumerate(lens)], "pos BIGINT, n BIGINT")
    want, acc, block = [], 0, 0
    for n in lens:
        want.append(block)
        acc += n
        if acc >= threshold:
            acc, block = 0, block + 1
    got = [r.block for r in packing.greedy_pack(df, "pos", "n", threshold).orderBy("pos").collect()]
    assert got == want
    looked_up = packing._pack_by_lookup(df.toDF("pos", "len"), threshold, sum(lens)).orderBy("pos").collect()
    assert [r.block for r in looked_up] == want


def test_greedy_pack_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(3)
    lens = [rng.choice([0, 1, 5, 40]) for _ in range(400)]
    df = spark.createDataFrame([(i * STRIDE, n) for i, n in enumerate(lens)], "pos BIGINT, n BIGINT")
    for threshold in (7, 90, 10**6):
        want, acc, block = [], 0, 0
        for n in lens:
            want.append(block)
            acc += n
            if acc >= threshold:
                acc, block = 0, block + 1
        got = [r.block for r in packing.greedy_pack(df, "pos", "n", threshold).orderBy("pos").collect()]
        assert got == want, threshold


@quick
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 70), st.integers(1, 4))
def test_credit_sample_matches_loop(spark, lens, samples, low):
    df = spark.createDataFrame([(i * STRIDE, n) for i, n in enumerate(lens)], "pos BIGINT, n BIGINT")
    full = [i for i, n in enumerate(lens) if n]
    want, taken = [], 0
    for i, at in enumerate(full):
        if low <= lens[at] <= 5 and i * samples >= taken * len(full):
            want.append(at * STRIDE)
            taken += 1
    got = sampling.credit_sample(df, "pos", "n", samples, low=low, high=5).orderBy("pos").collect()
    assert [r.pos for r in got] == want


@quick
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 20))
def test_byte_split_matches_loop(spark, lens, splits):
    df = spark.createDataFrame([(i * STRIDE, n) for i, n in enumerate(lens)], "pos BIGINT, n BIGINT")
    total, want, off = sum(lens), [], 0
    if total < splits:
        return
    for n in lens:
        want.append(next(i for i in range(splits) if off < (i + 1) * total // splits))
        off += n
    assert [r.part for r in packing.byte_split(df, "pos", "n", splits).orderBy("pos").collect()] == want


def test_histogram_rejects_empty(spark):
    df = spark.createDataFrame([(0,)], "n BIGINT")
    with pytest.raises(Exception, match="record without residues"):
        records.length_histogram(df, F.col("n")).collect()


def test_pack_records_and_parts(spark, tmp_path):
    import zlib

    df = spark.createDataFrame([(i, f">{i}\nMK\n") for i in range(5)], "pos BIGINT, raw STRING")
    packed = packing.pack_records(df, "pos", "raw", 10, encode=zlib.compress).orderBy("block").collect()
    text = "".join(zlib.decompress(bytes(r.payload)).decode() for r in packed)
    assert text == "".join(f">{i}\nMK\n" for i in range(5)) and [r.records for r in packed] == [2, 2, 1]
    parts = records.fixed_groups(df, "pos", 2)
    writers.write_parts(parts, str(tmp_path / "parts"))
    back = spark.read.text(str(tmp_path / "parts"))
    assert back.select("part").distinct().count() == 3 and back.count() == 10
    with pytest.raises(Exception, match="already exists"):
        writers.write_parts(parts, str(tmp_path / "parts"))
    writers.write_parts(parts, str(tmp_path / "parts"), force=True)
    spread = parts.withColumn("worker", F.lit(207))
    writers.write_spread(spread, str(tmp_path / "spread"), "worker")
    assert (tmp_path / "spread" / "hh=02" / "ll=07").is_dir()
    with pytest.raises(ValueError):
        writers.save_mode(force=True, append=True)


def _processes_started():
    return next(int(line.split()[1]) for line in open("/proc/stat") if line.startswith("processes"))


def test_spread_starts_no_process_per_folder(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 1000).alias("worker"), "id")
    writers.write_spread(rows, str(tmp_path / "first"), "worker")
    before = _processes_started()
    writers.write_spread(rows, str(tmp_path / "spread"), "worker")
    assert _processes_started() - before < 1000
    back = spark.read.parquet(str(tmp_path / "spread"))
    assert back.columns == ["worker", "id", "hh", "ll"] and back.count() == 2000
    assert back.where("worker = hh * 100 + ll AND worker = id % 1000").count() == 2000
    assert sorted(os.listdir(tmp_path / "spread")) == ["_SUCCESS"] + [f"hh={i:02d}" for i in range(10)]


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_spread_types_nulls_and_force(spark, tmp_path, scheme):
    if scheme == "viewfs":  # a store that Spark alone writes to
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.spread.link./at", f"file://{tmp_path}")
    path = {"file": f"file://{tmp_path}/spread", "viewfs": "viewfs://spread/at/spread"}[scheme]
    rows = spark.sql("""
        SELECT explode(array(7L, 7L, 207L, 12345L, -205L, NULL)) AS worker, 'x' AS ll, 1.50BD AS d, array(1, NULL) AS a,
          TIMESTAMP '2024-02-03 04:05:06.789' AS t, named_struct('b', X'00ff') AS s, INTERVAL '3' DAY AS i
    """)
    writers.write_spread(rows, path, "worker")
    back = spark.read.parquet(path)
    assert dict(back.dtypes) == dict(rows.dtypes) | {"hh": "int", "ll": "int"}
    columns = ["worker", "d", "a", "t", "s", "i"]
    assert sorted(back.select(columns).collect(), key=repr) == sorted(rows.select(columns).collect(), key=repr)
    places = back.select("worker", "hh", "ll").distinct().collect()
    read = writers.read_spread(spark, path).select(*back.columns[:-2], *writers.folder_numbers(F.col("file")))
    assert read.dtypes == back.dtypes and sorted(read.collect(), key=repr) == sorted(back.collect(), key=repr)
    assert {r.worker: (r.hh, r.ll) for r in places} == {
        7: (0, 7), 207: (2, 7), 12345: (123, 45), -205: (-2, -5), None: (None, None)
    }
    with pytest.raises(Exception, match="already exists"):
        writers.write_spread(rows, path, "worker")
    writers.write_spread(rows.where("worker = 207"), path, "worker", force=True)
    assert [(r.hh, r.ll) for r in spark.read.parquet(path).collect()] == [(2, 7)]


def test_spread_large_worker_is_split(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") < 100, F.col("id")).otherwise(7).alias("worker"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        writers.write_spread(rows, str(tmp_path / "spread"), "worker")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(os.listdir(tmp_path / "spread" / "hh=00" / "ll=07")) > 1
    back = spark.read.parquet(str(tmp_path / "spread"))
    assert back.count() == 60_000 and back.select("v").distinct().count() == 60_000
    assert back.where("worker <> ll OR hh <> 0").count() == 0


def test_mol2(spark, tmp_path):
    path = tmp_path / "m.mol2"
    path.write_text("@<TRIPOS>MOLECULE\nZ1\nx\n@<TRIPOS>MOLECULE\nZ2\ny\n")
    names = tmp_path / "names"
    names.write_text(" Z2 \nZ9\nZ2\n")
    found = records.named(delimited.read_mol2(spark, str(path)), delimited.read_names(spark, str(names)))
    assert [(r.name, r.raw) for r in found.collect()] == [("Z2", "@<TRIPOS>MOLECULE\nZ2\ny\n")]
    assert delimited.count_records(spark, str(path), delimited.MOL2_PREFIX) == 3


def test_cyclic_zip(spark):
    left = spark.createDataFrame([(i,) for i in range(5)], "pos BIGINT")
    right = spark.createDataFrame([(0, "p"), (1, "q")], "i BIGINT, w STRING")
    out = records.cyclic_zip(left, "pos", right, "i").orderBy("pos").collect()
    assert [r.cycle_w for r in out] == ["p", "q", "p", "q", "p"]
