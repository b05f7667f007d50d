import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from recordmill.operators import masking, similarity


def brute(text, window, word, least):
    letters = re.sub("[^A-Za-z]", "", text or "").upper()
    words = [letters[i : i + word] for i in range(len(letters) - word + 1)]
    hidden = set()
    for i in range(len(words) - window + 1):
        if sum(a == b for a, b in combinations(words[i : i + window], 2)) >= least:
            hidden |= set(range(i, i + window + word - 1))
    return hidden


def test_low_complexity(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTacgt- é") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    texts += ["A" * 500, "", None, "AAAAA", "ACACACACACACACACACACA" + "QWERTYUIOPLKJHGF" + "T" * 30, "é" * 40, "AB" * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for window, word, least in ((12, 1, 22), (8, 3, 4), (5, 2, 2), (12, 1, 0)):
        got = {}
        for r in masking.low_complexity(df, "id", "text", window=window, word=word, least=least).collect():
            got.setdefault(r["id"], []).append((r["start"], r["stop"]))
        for key, text in enumerate(texts):
            spans = sorted(got.get(key, []))
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
            assert {i for a, b in spans for i in range(a, b)} == brute(text, window, word, least), (key, window)


def test_merged(spark):
    rows = [(1, 5, 9), (1, 9, 12), (1, 0, 3), (1, 6, 7), (1, 5, 9), (2, 4, 4), (2, 7, 3), (None, 1, 2), (None, 2, 5)]
    got = masking.merged(spark.createDataFrame(rows, "id bigint, start bigint, stop bigint")).collect()
    assert sorted((r["id"] or 0, r["start"], r["stop"]) for r in got) == [(0, 1, 5), (1, 0, 3), (1, 5, 12)]


def test_unmasked(spark):
    rng = random.Random(8)
    found = [(rng.randint(1, 3), rng.randint(0, 300)) for _ in range(400)] + [(None, 5), (9, 1)]
    masks = [(rng.randint(1, 2), a, a + rng.randint(0, 60)) for a in (rng.randint(0, 300) for _ in range(12))] + [(1, 100, 100), (None, 0, 50)]
    left = spark.createDataFrame(found, "id bigint, at int")
    right = spark.createDataFrame(masks, "id bigint, start bigint, stop bigint")
    for size in (1, 7, 40):
        got = masking.unmasked(left, right, size, bin_letters=16).collect()
        want = [f for f in found if not any(f[0] == m[0] and f[0] is not None and m[1] < m[2] and m[1] < f[1] + size and m[2] > f[1] for m in masks)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), size


def test_masked_words_seed_nothing_but_are_aligned(spark):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    head, tail = draw(30), draw(30)
    passage = head + "A" * 25 + tail
    queries = spark.createDataFrame([(1, passage), (2, "A" * 40)], "id int, text string")
    records = spark.createDataFrame([(7, draw(50) + passage + draw(50)), (8, draw(40) + "A" * 60 + draw(40))], "id int, text string")
    mask = masking.low_complexity(records, "id", "text", window=12, least=30)
    query_mask = masking.low_complexity(queries, "id", "text", window=12, least=30)
    pairs = lambda **kw: {(r["query_id"], r["db_id"]) for r in similarity.seeds(queries, records, "id", "text", size=6, **kw).collect()}
    assert pairs() == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert pairs(mask=mask) == {(1, 7)} == pairs(query_mask=query_mask)
    scoring = similarity.Scoring(lam=0.2, kappa=0.1)
    hits = similarity.search(queries, records, size=6, scoring=scoring, mask=mask).where("segment = 1").collect()
    assert [(r["query_id"], r["db_id"], r["q_from"], r["q_to"]) for r in hits] == [(1, 7, 1, len(passage))]


def test_empty_mask_changes_nothing(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJKLMNOP")], "id int, text string")
    none = spark.createDataFrame([], "id int, start bigint, stop bigint")
    plain = similarity.seeds(df, df, "id", "text", size=4).collect()
    assert plain == similarity.seeds(df, df, "id", "text", size=4, mask=none, query_mask=none).collect() and plain


def test_no_python_between_masks_and_words(spark):
    found = spark.createDataFrame([(1, 2)], "id int, at int").select("id", F.col("at"))
    masks = spark.createDataFrame([(1, 2, 3)], "id int, start bigint, stop bigint")
    plan = masking.unmasked(found, masks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
