import pytest
from test_decontamination import brute as shared_words
from test_packing import PATH, check
from test_pii import plain
from test_superminhash import brute as duplicate_groups
from tokenizers import Tokenizer

import corpus_pipeline as C

TABLES = "/root/testdata/sf0.001"


def run_stages(spark, docs, folder):
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, folder), name)
        yield docs


def check_stages(spark, docs, folder, items):
    columns, rows = docs.columns, docs.collect()
    stages = run_stages(spark, docs, folder)
    named = next(stages)
    assert named.columns == columns
    want = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(named.collect(), key=str) == sorted(want, key=str)

    single = next(stages)
    groups = duplicate_groups({(r["doc_id"], r["text"]) for r in want if r["doc_id"] is not None}, 5)
    kept = {d for d, _, _, own in groups if own}
    assert single.columns == columns
    found = single.collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted(kept)

    fresh = next(stages)
    clean = [r for r in found if not shared_words(r["text"], items)[1]]
    assert fresh.columns == columns and sorted(fresh.collect(), key=str) == sorted(clean, key=str)

    private = next(stages)
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert private.columns == columns and texts.keys() == {r["doc_id"] for r in clean}
    for r in clean:
        if not plain(r["text"]):
            assert texts[r["doc_id"]] == r["text"]
        assert not plain(texts[r["doc_id"]])

    pieces = next(stages).collect()
    coder = Tokenizer.from_file(PATH)
    check(pieces, [(d, coder.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts.items()])


def test_tables(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    check_stages(spark, spark.read.parquet(f"{TABLES}/documents.parquet"), TABLES, items)


def test_edge_rows(spark, edge_docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    check_stages(spark, edge_docs, str(tmp_path), [tuple(r) for r in benchmark.collect()])
    assert [d.count() for d in run_stages(spark, edge_docs.limit(0), str(tmp_path))] == [0] * 5


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is C.run
    assert C.ORACLE_SQL is None and 4 <= len(C.STAGES) <= 5
    with pytest.raises(Exception):
        C.run(spark, "/no/such/folder")
