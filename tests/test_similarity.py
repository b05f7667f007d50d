import math
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.functions import alignment
from recordmill.functions.alignment import segments
from recordmill.operators import similarity as S

LETTERS = "ACDEFG"


def local_score(a, b, scoring):
    """Textbook affine-gap local alignment."""
    low = -(10**9)
    first, more = scoring.gap_open + scoring.gap_extend, scoring.gap_extend
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    x = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    y = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x[i][j] = max(m[i - 1][j] - first, x[i - 1][j] - more)
            y[i][j] = max(m[i][j - 1] - first, y[i][j - 1] - more)
            hit = scoring.match if a[i - 1] == b[j - 1] else scoring.mismatch
            m[i][j] = max(0, m[i - 1][j - 1] + hit, x[i][j], y[i][j])
            best = max(best, m[i][j])
    return best


def texts(rng, count, length, least=1):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(least, length))) for _ in range(count)]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    queries = texts(rng, 6, 30, least=20)
    docs = texts(rng, 30, 60) + ["", "é, ".join(queries[0].lower()), queries[1][:10] + "C" + queries[1][10:]]
    as_df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id INT, text STRING")
    clean = ["".join(c for c in d.upper() if "A" <= c <= "Z") for d in docs]
    return queries, clean, as_df(queries), as_df(docs)


def brute_seeds(queries, docs, size, least):
    out = {}
    for q, a in enumerate(queries):
        for d, b in enumerate(docs):
            for i in range(len(a) - size + 1):
                for j in range(len(b) - size + 1):
                    if a[i : i + size] == b[j : j + size]:
                        out[(q, d, j - i)] = out.get((q, d, j - i), 0) + 1
    return {k: v for k, v in out.items() if v >= least}


@pytest.mark.parametrize("hot, bits, window", [(10**6, 30, 3), (2, 30, 1 << 16), (2, 16, 1 << 16)])
def test_seeds(sides, monkeypatch, hot, bits, window):
    monkeypatch.setattr(S, "SCAN_LETTERS", window)
    monkeypatch.setattr(S, "HOT_WORD", hot)
    monkeypatch.setattr(S, "FILTER_BITS", bits)
    queries, docs, q_df, d_df = sides
    found = S.seeds(q_df, d_df, "id", "text", size=3, min_seeds=2)
    got = {(r.query_id, r.db_id, r.diagonal): r.seeds for r in found.collect()}
    assert got == brute_seeds(queries, docs, 3, 2)


def test_words_match_scan(spark, sides):
    _, docs, _, d_df = sides
    listed = {(r.id, r.at, r.word) for r in S.words(d_df, "id", "text", 4).collect()}
    assert listed == {(d, i, b[i : i + 4]) for d, b in enumerate(docs) for i in range(len(b) - 3)}
    wanted = {w for _, _, w in list(listed)[::3]}
    filtered = spark.createDataFrame([(w,) for w in sorted(wanted)], "word STRING")
    scanned = {(r.id, r.at, r.word) for r in S.matching_words(d_df, "id", "text", 4, filtered).collect()}
    assert {x for x in listed if x[2] in wanted} <= scanned <= listed


def test_ungapped(sides):
    queries, docs, q_df, d_df = sides
    scoring = S.Scoring(match=2, mismatch=-3)
    found = S.seeds(q_df, d_df, "id", "text", size=3, min_seeds=1)
    rows = S.extend_ungapped(found, q_df, d_df, "id", "text", scoring).collect()
    assert len(rows) == len(brute_seeds(queries, docs, 3, 1))
    for r in rows:
        a, b = queries[r.query_id], docs[r.db_id]
        pairs = [(i, i + r.diagonal) for i in range(len(a)) if 0 <= i + r.diagonal < len(b)]
        gains = [2 if a[i] == b[j] else -3 for i, j in pairs]
        best = max(sum(gains[x:y]) for x in range(len(gains)) for y in range(x + 1, len(gains) + 1))
        assert r.score == best
        cut = range(r.q_from - 1, r.q_to)
        assert sum(2 if a[i] == b[i + r.diagonal] else -3 for i in cut) == best
        assert r.d_from - r.q_from == r.diagonal and r.d_to - r.q_to == r.diagonal


def rescored(s, scoring):
    total, last = 0, None
    for a, b in zip(s.q_aligned, s.d_aligned):
        side = "q" if a == "-" else "d" if b == "-" else None
        if side:
            total -= scoring.gap_extend + (scoring.gap_open if side != last else 0)
        else:
            total += scoring.match if a == b else scoring.mismatch
        last = side
    return total


def test_traceback_in_linear_space(monkeypatch):
    rng = random.Random(5)
    for scoring in (S.Scoring(match=5, mismatch=-4, gap_open=3, gap_extend=1), S.Scoring(gap_open=0, gap_extend=2), S.Scoring(gap_open=9, gap_extend=0)):
        for a, b in zip(texts(rng, 40, 30), texts(rng, 40, 30)):
            x, y = (np.frombuffer(v.encode(), np.uint8) for v in (a, b))
            given = (x, y, scoring.table(), scoring.gap_open, scoring.gap_extend)
            monkeypatch.setattr(alignment, "CELLS", 1 << 21)
            whole = alignment.traceback(*given)
            monkeypatch.setattr(alignment, "CELLS", 12)
            cut = alignment.traceback(*given)
            for left, right in (whole, cut):
                assert (left.replace("-", ""), right.replace("-", "")) == (a, b) and ("-", "-") not in zip(left, right)
            score = lambda two: rescored(SimpleNamespace(q_aligned=two[0], d_aligned=two[1]), scoring)
            assert score(whole) == score(cut)


def test_memory_of_long_alignments():
    rng = random.Random(7)
    a = "".join(rng.choice(LETTERS) for _ in range(12_000))
    b = a[:5000] + a[5200:9000] + "AC" * 40 + a[9000:]
    scoring = S.Scoring()
    tracemalloc.start()
    (found,) = segments(a, b, [0, -200], scoring.table(), scoring.gap_open, scoring.gap_extend, 40_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Three whole tables would take 3.4 GB.
    assert peak < 60 << 20
    assert found.score == rescored(found, scoring) and found.gaps == 280 and found.identities == 11_800


@pytest.mark.parametrize("most", [1, 10_000])
def test_pairs_of_a_hot_record(spark, monkeypatch, most):
    monkeypatch.setattr(S, "PAIRS_PER_TASK", most)
    rng = random.Random(9)
    record = "".join(rng.choice(LETTERS) for _ in range(400))
    queries = [record[i : i + 40] for i in range(0, 200, 20)]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id INT, text STRING")
    found = S.search(frame(queries), frame([record, "A"]), size=8, scoring=S.Scoring(lam=0.2, kappa=0.05)).where("segment = 1")
    assert {(r.query_id, r.db_id, r.score, r.d_from) for r in found.collect()} == {(i, 0, 200, 20 * i + 1) for i in range(10)}


def test_segments():
    rng = random.Random(4)
    for scoring in (S.Scoring(match=5, mismatch=-4, gap_open=3, gap_extend=1), S.Scoring(gap_open=0, gap_extend=2)):
        for a, b in zip(texts(rng, 25, 25), texts(rng, 25, 40)):
            found = segments(a, b, range(-len(a), len(b)), scoring.table(), scoring.gap_open, scoring.gap_extend, 1)
            assert (found[0].score if found else 0) == local_score(a, b, scoring)
            for s in found:
                assert s.q_aligned.replace("-", "") == a[s.q_from - 1 : s.q_to]
                assert s.d_aligned.replace("-", "") == b[s.d_from - 1 : s.d_to]
                assert rescored(s, scoring) == s.score
            spans = sorted((s.d_from, s.d_to) for s in found)
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_search(sides):
    queries, docs, q_df, d_df = sides
    scoring = S.Scoring(match=5, mismatch=-4, gap_open=3, gap_extend=1, lam=0.2, kappa=0.05)
    found = S.search(q_df, d_df, size=3, scoring=scoring, max_evalue=1e9).collect()
    best = {(r.query_id, r.db_id): r for r in found if r.segment == 1}
    assert set(best) == {(q, d) for q, d, _ in brute_seeds(queries, docs, 3, 2)}
    total = sum(map(len, docs))
    for (q, d), r in best.items():
        assert r.score == local_score(queries[q], docs[d], scoring)
    for r in found:
        assert rescored(r, scoring) == r.score and r.identities == sum(x == y for x, y in zip(r.q_aligned, r.d_aligned))
        assert r.evalue == pytest.approx(scoring.kappa * len(queries[r.query_id]) * total * math.exp(-scoring.lam * r.score))
        assert r.bits == pytest.approx((scoring.lam * r.score - math.log(scoring.kappa)) / math.log(2))
    cut = S.search(q_df, d_df, size=3, scoring=scoring, max_evalue=0.5)
    key = lambda r: (r.query_id, r.db_id, r.segment)
    assert sorted(map(key, cut.collect())) == sorted(key(r) for r in found if r.evalue <= 0.5)
    with pytest.raises(ValueError):
        S.search(q_df, d_df, scoring=S.Scoring())


def test_best_hit_of_two_diagonals(spark):
    rng = random.Random(6)
    query = "".join(rng.choice("ACDEFGHIKL") for _ in range(40))
    pad = lambda n: "".join(rng.choice("MNPQRS") for _ in range(n))
    record = pad(50) + query[8:32] + pad(3000) + query[:20] + "W" + query[20:] + pad(50)
    frame = lambda text: spark.createDataFrame([(1, text)], "id INT, text STRING")
    scoring = S.Scoring(lam=0.2, kappa=0.05)
    found = S.search(frame(query), frame(record), size=8, scoring=scoring).orderBy("segment").collect()
    assert [r.score for r in found] == [40 * 5 - 12, 24 * 5]
    assert (found[0].q_from, found[0].q_to, found[0].gaps, found[0].identities) == (1, 40, 1, 40)
    assert (found[1].d_from, found[1].d_to) == (51, 74)


def test_fitted_statistics():
    flat = S.Scoring(match=1, mismatch=-1, gap_open=50, gap_extend=50)
    fitted = S.fit_statistics(flat, dict.fromkeys("ACGT", 0.25), length=200, pairs=150)
    assert fitted.lam == pytest.approx(math.log(3), rel=0.25) and 0 < fitted.kappa < 2


def test_screen_and_profile(spark):
    vector = "ACDEFGACCDDEEFFGGAACADAEAF" * 2
    rng = random.Random(8)
    pad = lambda n: "".join(rng.choice("HIKLM") for _ in range(n))
    docs = [vector[:20] + pad(80), pad(40) + vector[:20] + pad(40), pad(40) + vector[:27] + pad(40), pad(90)]
    d_df = spark.createDataFrame(list(enumerate(docs)), "id INT, text STRING")
    v_df = spark.createDataFrame([(7, vector)], "id INT, text STRING")
    hits = S.screen(d_df, v_df, "id", "text", size=8).groupBy("record_id").agg(F.max_by("strength", "score").alias("s"))
    assert {r.record_id: r.s for r in hits.collect()} == {0: "moderate", 2: "moderate"}
    # Two segments on one diagonal, and an exact match of the weakest score at an end.
    twice = spark.createDataFrame([(1, vector[:22] + "H" * 8 + vector[30:] + pad(20)), (2, vector[:16] + pad(60))], "id INT, text STRING")
    unlike = spark.createDataFrame([(7, vector[:22] + "W" * 8 + vector[30:])], "id INT, text STRING")
    rows = S.screen(twice, unlike, "id", "text").collect()
    assert {(r.record_id, r.q_from, r.q_to, r.score) for r in rows} >= {(1, 1, 22, 22), (1, 31, 52, 22), (2, 1, 16, 16)}
    consensus = vector[:12]
    scores = [{c: 3} for c in consensus]
    profiles = spark.createDataFrame([(1, consensus, scores)], "profile_id INT, consensus STRING, scores ARRAY<MAP<STRING,INT>>")
    found = S.profile_diagonals(profiles, d_df, "id", "text", size=6).collect()
    assert {(r.db_id, r.score) for r in found} >= {(0, 36), (1, 36), (2, 36)}


def test_screen_misses_nothing(spark):
    rng = random.Random(12)
    vectors = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (42, 90, 160)]
    other = lambda c: rng.choice([x for x in "ACGT" if x != c])
    change = lambda v, places: "".join(other(c) if i in places else c for i, c in enumerate(v))
    # Three others at 10, 21 and 32 leave runs of ten; every seventh letter leaves runs of six.
    docs = [change(vectors[0], {10, 21, 32}), change(vectors[2], set(range(6, 160, 7)))]
    docs += [change(v, set(rng.sample(range(len(v)), k))) for v in vectors for k in (2, 5, 9, 14)]
    docs = ["".join(rng.choice("ACGT") for _ in range(30)) + d for d in docs] + docs[:1]
    want = set()
    for v, a in enumerate(vectors):
        for d, b in enumerate(docs):
            for diagonal in range(-len(a) + 1, len(b)):
                at = [i for i in range(len(a)) if 0 <= i + diagonal < len(b)]
                gains = np.array([1 if a[i] == b[i + diagonal] else -5 for i in at])
                for hit in S._stretches(gains, 16):
                    q_from = at[0] + diagonal + hit["first"] + 1
                    q_to = at[0] + diagonal + hit["last"] + 1
                    end = q_from <= 25 or q_to > len(b) - 25
                    if hit["score"] >= (16 if end else 23):
                        want.add((d, v, q_from, q_to, hit["score"]))
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id INT, text STRING")
    found = S.screen(frame(docs), frame(vectors), "id", "text").collect()
    assert {(r.record_id, r.contaminant_id, r.q_from, r.q_to, r.score) for r in found} == want
    assert (len(docs) - 1, 0, 1, 42, 24) in want and len(want) > 8


def test_lambda_and_matrix():
    scores = np.where(np.eye(4, dtype=bool), 1, -1)
    lam = S.solve_lambda(scores, np.full(4, 0.25))
    assert lam == pytest.approx(math.log(3))
    with pytest.raises(ValueError):
        S.solve_lambda(np.ones((2, 2)), np.full(2, 0.5))
    table = S.Scoring(matrix={("A", "R"): -1, ("A", "A"): 4}).table()
    assert table[ord("A"), ord("R")] == -1 and table[ord("A"), ord("A")] == 4


def test_seeds_of_a_record_meet_in_one_task(spark, monkeypatch):
    """Both joins count the same seeds; the replicated one shuffles places, not diagonals, in bounded tasks."""
    rng = random.Random(8)
    make = lambda n, size: [(k, "".join(rng.choice("AB") for _ in range(size))) for k in range(n)]
    queries = spark.createDataFrame(make(4, 30), "id bigint, text string")
    records = spark.createDataFrame(make(60, 50), "id bigint, text string").coalesce(1)
    monkeypatch.setattr(S, "TASK_SEEDS", 100)
    found = S.seeds(queries, records, "id", "text", size=4, min_seeds=3)
    total = sum(r.seeds for r in S.seeds(queries, records, "id", "text", size=4, min_seeds=1).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(db_id" in plan and plan.count("hashpartitioning(query_id") == 0
    assert found.rdd.getNumPartitions() >= total / 100
    monkeypatch.setattr(S, "REPLICATED_WORDS", 0)
    joined = S.seeds(queries, records, "id", "text", size=4, min_seeds=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) != []
