import zlib

import numpy as np

from recordmill.llm import language as L

TABLES = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    named = L.identify(docs, L.learn(docs.where(~L.held_out("doc_id")))).collect()
    out = [r for r in named if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(named) == docs.count() and len(out) > 30
    assert np.mean([r["lang"] == r["__lang"] for r in out]) > 0.95
    assert all(0 <= r["__score"] <= 1 for r in named)


def test_edge_rows(spark, edge_docs):
    got = L.identify(edge_docs, L.learn(edge_docs)).collect()
    assert len(got) == edge_docs.count()
    unknown = {r["doc_id"] for r in got if r["__lang"] == "und"}
    assert unknown == {2, 3, 4} and all(r["__score"] == 0 for r in got if r["doc_id"] in unknown)
    kept = L.accepted(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    unlabelled = edge_docs.where("lang IS NULL")
    assert {r["doc_id"] for r in L.accepted(unlabelled).collect()} == {6}
    assert L.accepted(edge_docs.limit(0)).count() == 0


def test_grams_and_vectors():
    owner, gram, alphabet = L.grams(["Ab, a", None, "", "1!", "é"])
    letters = [0, ord("a"), ord("b"), ord("é")]
    assert alphabet.tolist() == letters
    spelled = [tuple(letters[g // 4**k % 4] for k in (2, 1, 0)) for g in gram.tolist()]
    a, b, e = letters[1:]
    assert list(zip(owner.tolist(), spelled)) == [(0, (0, a, b)), (0, (a, b, 0)), (0, (b, 0, a)), (0, (0, a, 0)), (4, (0, e, 0))]
    vector = L.gram_vectors(gram[:1], alphabet, 64)[0]
    want = np.roll(L.letter_vector(0, 64), 2) * np.roll(L.letter_vector(a, 64), 1) * L.letter_vector(b, 64)
    assert (vector == want).all()
