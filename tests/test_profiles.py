import math
import random

import numpy as np
import pytest

from recordmill.operators import similarity as S

LETTERS = "ACDEFGH"


def brute(columns, text, open_, more):
    """Best local alignment of a profile and a text, cell by cell."""
    low = -(10**9)
    m = [[0] * (len(text) + 1) for _ in range(len(columns) + 1)]
    x = [[low] * (len(text) + 1) for _ in range(len(columns) + 1)]
    y = [[low] * (len(text) + 1) for _ in range(len(columns) + 1)]
    best = 0
    for i in range(1, len(columns) + 1):
        for j in range(1, len(text) + 1):
            x[i][j] = max(m[i - 1][j] - open_ - more, x[i - 1][j] - more)
            y[i][j] = max(m[i][j - 1] - open_ - more, y[i][j - 1] - more)
            m[i][j] = max(0, m[i - 1][j - 1] + columns[i - 1].get(text[j - 1], -2), x[i][j], y[i][j])
            best = max(best, m[i][j])
    return best


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(31)
    profiles = {}
    for k in range(5):
        columns = []
        for _ in range(rng.randint(8, 26)):
            first, second = rng.sample(LETTERS, 2)
            columns.append({first: rng.choice([3, 5]), second: rng.choice([1, 4])})
        profiles[k] = columns
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 70))) for _ in range(60)]
    for columns in profiles.values():
        shown = [rng.choice(sorted(c)) for c in columns]
        for cut in (len(shown) // 2, len(shown) // 3):
            texts.append("".join(rng.choice(LETTERS) for _ in range(9)) + "".join(shown[:cut]) + "AC" + "".join(shown[cut:]))
            texts.append("".join(shown[:cut] + shown[cut + 1 :]).lower() + ", é")
    texts.append(None)
    as_df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    models = spark.createDataFrame(list(profiles.items()), "profile_id INT, scores ARRAY<MAP<STRING,INT>>")
    clean = ["".join(c for c in (t or "").upper() if "A" <= c <= "Z") for t in texts]
    return profiles, clean, models, as_df


@pytest.mark.parametrize("size, open_, more, max_evalue", [(3, 11, 1, 5.0), (2, 4, 2, 0.5), (4, 11, 1, 50.0)])
def test_no_pair_is_missed(tables, size, open_, more, max_evalue):
    profiles, texts, models, as_df = tables
    lam, kappa = 0.3, 0.1
    got = S.profile_search(
        models, as_df, "id", "text", size=size, other=-2, gap_open=open_, gap_extend=more, lam=lam, kappa=kappa, max_evalue=max_evalue
    ).collect()
    total, want = sum(map(len, texts)), {}
    for p, columns in profiles.items():
        for d, text in enumerate(texts):
            score = brute(columns, text, open_, more)
            if score > 0 and kappa * total * len(columns) * math.exp(-lam * score) <= max_evalue:
                want[p, d] = score
    assert {(r["profile_id"], r["db_id"]): r["score"] for r in got} == want and len(got) == len(want) > 10
    for r in got:  # the best alignment of what is reported is the whole of it
        part = texts[r["db_id"]][r["d_from"] - 1 : r["d_to"]]
        assert brute(profiles[r["profile_id"]][r["p_from"] - 1 : r["p_to"]], part, open_, more) == r["score"]
        assert r["d_len"] == len(texts[r["db_id"]]) and r["columns"] == len(profiles[r["profile_id"]])


def test_match_without_a_word_of_the_consensus(spark):
    """Every second column takes two letters; the record has the rarer one each time."""
    consensus = "ABCDEFGHIJKL"
    scores = [{c: 5, "Z": 4} if k % 2 else {c: 5} for k, c in enumerate(consensus)]
    hidden = "".join("Z" if k % 2 else c for k, c in enumerate(consensus))
    records = spark.createDataFrame([(1, "qq" + hidden + "qq"), (2, "xxxx")], "id INT, text STRING")
    model = spark.createDataFrame([("p", consensus, scores)], "profile_id STRING, consensus STRING, scores ARRAY<MAP<STRING,INT>>")
    assert S.profile_diagonals(model, records, "id", "text", size=2, min_seeds=1).count() == 0
    (hit,) = S.profile_search(model, records, "id", "text", lam=0.4, kappa=0.1, max_evalue=0.01).collect()
    assert (hit["db_id"], hit["score"], hit["p_from"], hit["p_to"], hit["d_from"], hit["d_to"]) == (1, 54, 1, 12, 3, 14)


def test_words_by_branch_and_bound(tables):
    profiles, _, models, _ = tables
    column = lambda c: [c.get(x, -2) for x in S.ALPHABET]
    wide = models.sparkSession.createDataFrame(
        [(k, [column(c) for c in v], 7) for k, v in profiles.items()], "profile_id INT, columns ARRAY<ARRAY<INT>>, threshold INT"
    )
    got = {tuple(r) for r in S.profile_words(wide, 3).collect()}
    want = set()
    for k, columns in profiles.items():
        for at in range(len(columns) - 2):
            for a in S.ALPHABET:
                for b in S.ALPHABET:
                    for c in S.ALPHABET:
                        if sum(col.get(x, -2) for col, x in zip(columns[at : at + 3], a + b + c, strict=True)) >= 7:
                            want.add((k, at, a + b + c))
    assert got == want


def test_empty_sides(tables):
    _, _, models, as_df = tables
    for p, d in ((models.limit(0), as_df), (models, as_df.limit(0)), (models, as_df.where("text IS NULL"))):
        assert S.profile_search(p, d, "id", "text", lam=0.3, kappa=0.1).count() == 0


def test_side_by_side_alignment():
    rng = np.random.default_rng(2)
    for gap_open, more in ((3, 1), (5, 0)):
        columns = rng.integers(-3, 6, (15, 26))
        parts = [rng.integers(0, 6, n).astype(np.int64) for n in (1, 40, 7, 25)]
        scores, _, _ = S._best_ends(columns, parts, gap_open, more)
        for score, part in zip(scores, parts, strict=True):
            assert S.best_end(np.arange(15), part, columns, gap_open, more)[0] == score
