import random
import re

import pyarrow as pa
import pytest

from recordmill.operators import inverted as I

WORDS = "the of and cat dog bird fish tree".split()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(k * 7001 - 50_000, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), rng.choice(["en", "fr", None]), rng.randint(-5, 40)) for k in range(300)]
    rows += [(rows[3][0], "The extra-words", "de", 7), (None, "the", "en", 1), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, n int").repartition(4)
    path = str(tmp_path_factory.mktemp("index") / "i")
    I.write_index(df, "id", path, words={"text": "text"}, keys={"lang": "lang"}, numbers={"n": "n"}, buckets=5)
    held = {}
    for key, text, lang, n in rows:
        if key is not None:
            found = held.setdefault(key, set())
            found |= {("text", w) for w in re.findall("[a-z]+", (text or "").lower())}
            found |= {("lang", lang)} if lang else set()
            found |= {("n", n)} if n is not None else set()
    return I.Index.open(spark, path), held


def brute(query, held):
    if isinstance(query, I.Term):
        return {k for k, v in held.items() if (query.field, query.term) in v}
    if isinstance(query, I.Range):
        return {k for k, v in held.items() if any(f == query.field and query.low <= x <= query.high for f, x in v if f == "n")}
    if isinstance(query, I.Ids):
        return set(query.ids)
    if isinstance(query, I.ButNot):
        return brute(query.keep, held) - brute(query.drop, held)
    parts = [brute(p, held) for p in query.parts]
    return set.intersection(*parts) if isinstance(query, I.And) else set.union(*parts)


def test_queries(index):
    found, held = index
    t = lambda w: I.Term("text", w)
    queries = [
        t("the"),
        t("absent"),
        I.all_of(t("the"), t("cat")),
        I.any_of(t("fish"), I.Term("lang", "fr")),
        I.ButNot(I.any_of(t("the"), t("dog")), I.Range("n", -3, 12)),
        I.all_of(I.Range("n", 0, 20), I.Range("n", 10, 99), I.terms("text", ["bird", "tree"])),
        I.all_of(I.Ids((5, -50_000, -42_999, 123)), I.any_of(t("the"), t("of"), t("and"))),
        I.ButNot(t("the"), t("the")),
    ]
    for query in queries:
        got = [r["id"] for r in found.retrieve(query).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(query, held), query


def test_dictionary(index):
    found, held = index
    counts = {r["term"]: r["records"] for r in found.term_counts("text").collect()}
    assert counts == {w: len(brute(I.Term("text", w), held)) for w in {t for v in held.values() for f, t in v if f == "text"}}


def test_one_bucket_is_read(index):
    found, _ = index
    plan = found.postings(I.Term("text", "the"))._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "(bucket#" in scan.split("PartitionFilters")[1] and "EqualTo(term,the)" in plan
    assert "text" not in re.search(r"ReadSchema: \S+", plan).group()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id bigint, text string")
    I.write_index(df, "id", str(tmp_path / "i"), words={"text": "text"})
    found = I.Index.open(spark, str(tmp_path / "i"))
    assert found.retrieve(I.Term("text", "the")).count() == 0 and found.term_counts("text").count() == 0


def test_runs():
    """Terms leave a task once per run and block, however many records hold them."""
    def batches():
        for k in range(0, 70_000, 1000):
            texts = pa.array([f"the ab{'é' if i % 2 else ' '}cd" if i % 7 else None for i in range(k, k + 1000)])
            yield pa.record_batch([pa.array(range(k - 3, k + 997), pa.int64()), texts, pa.array(["en", None] * 500)], ["id", "f0", "f1"])

    got = {}
    for batch in I._tallied(batches(), [("text", True), ("lang", False)]):
        for r in batch.to_pylist():
            key = r["field"], r["term"], r["block"]
            assert key not in got
            got[key] = r["places"]
    words = [("text", w, b) for w in ("the", "ab", "cd") for b in (-1, 0, 1)]
    assert set(got) == {*words, *(("lang", "en", b) for b in (-1, 0, 1))}
    for key in words:
        assert [p + key[2] * I.SPAN for p in got[key]] == [i - 3 for i in range(70_000) if i % 7 and (i - 3) // I.SPAN == key[2]]
