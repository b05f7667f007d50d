import random
import re
from collections import Counter

import numpy as np
import pytest

from recordmill.llm import superminhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size=4):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((d, len(s), root(d), root(d) == d) for d, s in sets)


def corpus():
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, number = [], 0
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 40, 120]))]
        for _ in range(draw.choice([1, 6, 25])):
            own = list(base)
            for _ in range(draw.choice([0, 1, 2, 4, 8])):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((number, " ".join(own)))
            number += 1
    common = " ".join(draw.choice(vocabulary) for _ in range(60))
    for _ in range(40):  # a passage that many share, with an own end
        rows.append((number, common + " " + " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(4, 30)))))
        number += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "_BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, S.groups(docs).collect())) == brute(rows)


def test_edge_rows(edge_docs):
    got = {(r["doc_id"], r["n_shingles"]): r for r in S.groups(edge_docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect() if r["doc_id"] is not None]
    want = brute([r for k, r in enumerate(rows) if r not in rows[:k]])
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.values() if r["doc_id"] is not None} == set(want)
    kept = S.representatives(edge_docs, banding=S.Banding(shingle=5))
    assert kept.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 2, 3, 4, 5, 7, 9, 10, None])
    assert S.groups(edge_docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(4)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for size, common in [(400, 300), (60, 30), (5, 4)]:
        left, right = pool[:size], pool[size - common : 2 * size - common]
        held = S.signatures(np.concatenate([left, right]), np.array([0, size, 2 * size]), 240)
        assert np.isfinite(held).all()
        assert abs((held[0] == held[1]).mean() - common / (2 * size - common)) < 0.12
        # a slot depends on the set only
        again = S.signatures(left[::-1].copy(), np.array([0, size]), 240)
        assert (again[0] == held[0]).all()
