import re

import numpy as np
import pytest

from recordmill.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=10):
    own = words(text)
    hit, found, longest = [False] * len(own), set(), 0
    for item, other in items:
        w = words(other)
        size = min(window, len(w))
        windows = {tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if w else set()
        for p in range(len(own) - size + 1):
            if tuple(own[p : p + size]) in windows:
                found.add("" if item is None else str(item))
                hit[p : p + size] = [True] * size
                for s in range(len(w) - size + 1):
                    n = 0
                    while s + n < len(w) and p + n < len(own) and w[s + n] == own[p + n]:
                        n += 1
                    longest = max(longest, n if n >= size else 0)
    return len(own), sum(hit), sorted(found), longest


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equals_brute_force(edge_docs, benchmark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    items = [tuple(r) for r in benchmark.collect()]
    got = D.annotate(edge_docs, benchmark).collect()
    assert len(got) == edge_docs.count()
    for row in got:
        spans = list(zip(row["__hit_start"], row["__hit_end"]))
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        hit = sum(b - a for a, b in spans)
        assert (row["__hit_words"], hit, list(row["__hit_items"]), row["__hit_longest"]) == brute(row["text"], items)


def test_clean_keeps_columns_and_clean_rows(spark, edge_docs, benchmark):
    kept = D.clean(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 6, 9, 10}
    assert D.clean(edge_docs, benchmark.limit(0)).count() == edge_docs.count()
    assert D.clean(edge_docs.limit(0), benchmark).count() == 0


def test_suffix_array_is_sorted_to_its_depth():
    draw = np.random.default_rng(1)
    for n, letters, depth in [(1, 2, 5), (300, 2, 40), (500, 60, 9)]:
        codes = draw.integers(0, letters, n)
        order = D.suffix_array(codes, depth)
        runs = [tuple(codes[p : p + depth]) for p in order]
        assert sorted(order) == list(range(n)) and runs == sorted(runs)
