import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import linededup
from recordmill.llm.linededup import PerfectHash

BLANK = " \t\v\f\r\n"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars, min_docs):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    smallest = lambda d: (d is not None, d)
    keeper = {k: max(v, key=smallest) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def annotated(docs, index, **kw):
    found = linededup.annotate(docs, index, **kw)
    return sorted((tuple(r) for r in found.select("doc_id", "__lines", "__dropped", "__kept").collect()), key=repr)


def test_against_brute_force(spark):
    draw = np.random.default_rng(3)
    pool = ["Line é number %d of some length" % k for k in range(12)] + ["short", "", "   ", "\t x \r"]
    rows = [(int(k % 37), "\n".join(draw.choice(pool, draw.integers(0, 9)))) for k in range(60)]
    rows += [(None, pool[0] + "\n" + pool[1].upper()), (None, pool[0]), (100, None), (101, ""), (102, "\n\n" + "  " + pool[2] + " \r\n"), (103, pool[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for min_chars, min_docs in ((20, 2), (20, 5), (3, 4)):
        index = linededup.build_index(docs, min_chars=min_chars, min_docs=min_docs)
        assert annotated(docs, index) == brute(rows, min_chars, min_docs)
    index = linededup.build_index(docs, min_chars=20, min_docs=2)
    assert annotated(docs, index, min_docs=5) == brute(rows, 20, 5)
    with pytest.raises(ValueError):
        linededup.annotate(docs, index, min_docs=1)


def test_edge_rows(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    index = linededup.build_index(edge_docs, min_docs=2)
    clashing = edge_docs.withColumn("__kept", F.lit(1)).withColumn("first", F.lit("x"))
    assert annotated(clashing, index) == brute(rows, 40, 2)
    out = linededup.deduplicated(clashing, min_docs=2)
    assert out.columns == clashing.columns and out.where("text IS NULL").count() == 1
    empty = edge_docs.limit(0)
    assert linededup.build_index(empty).path is None
    assert linededup.annotate(empty, index).count() == 0


def test_text_of_any_id_type(spark):
    rows = [(f"d{k}", "a line that is longer than forty code points, surely\nrest %d" % k) for k in range(7)]
    docs = spark.createDataFrame(rows, "name string, body string")
    out = {r["name"]: r["body"] for r in linededup.deduplicated(docs, doc_id="name", text="body").collect()}
    assert out["d6"] == rows[6][1] and all(out[f"d{k}"] == f"rest {k}" for k in range(6))


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    rows = [(k, "\n".join(f"{j:045d}" for j in range(k % 50, 200, 3))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    index = linededup.build_index(docs)
    assert index.shards > 5 and annotated(docs, index) == brute(rows, 40, 5)


def test_perfect_hash():
    draw = np.random.default_rng(1)
    for n in (0, 1, 5, 20_000):
        keys = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        found, order = PerfectHash.build(keys)
        assert sorted(order) == list(range(len(keys)))
        assert (found.number(keys[order]) == np.arange(len(keys))).all()
        assert (found.number(draw.integers(0, 1 << 63, 100, dtype=np.uint64)) < max(len(keys), 1)).all()
    twice = np.array([7, 7, 9], np.uint64)  # equal first hashes are listed at the end
    found, order = PerfectHash.build(twice)
    shard = linededup.Shard(found, np.array([1, 2, 3], np.uint64)[order], np.array([5, 5, 5]), None)
    at = shard.find(twice, np.array([1, 2, 3], np.uint64), 5)
    assert sorted(at) == [0, 1, 2] and shard.find(np.array([7], np.uint64), np.array([4], np.uint64), 5)[0] == -1
