import random
import re
import zlib
from collections import Counter

import numpy as np

from recordmill.llm import spelling


def edits(word, letters):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters}
    return out - {word}


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_forms(counts, letters):
    near = {w: sorted(e for e in edits(w, letters) if e in counts) for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return rows


def test_counts(spark, edge_docs):
    draw = random.Random(2)
    letters = "abÀéÿ"
    texts = [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(5, 9))) + draw.choice(" 1×Ł_") for _ in range(300)) for _ in range(40)]
    rows = [(k % 30, t) for k, t in enumerate(texts)] + [(None, texts[0]), (-5, texts[1].upper()), (7, None), (8, "")]
    rows += [(9, "x" * 100_000 + " " + "é" * 80 + " " + "é" * 80), (9, "x" * 100_000)]
    rows += [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs.withColumnRenamed("text", "body"), text="body").collect()}
    assert got == brute_counts(rows)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_forms(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 3)  # a dictionary with entries, lists in several partitions
    monkeypatch.setattr(spelling, "LIST_ROWS", 8)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    draw = random.Random(4)
    letters = "abé"
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(7, 9))): draw.choice([2, 3, 25, 300, 4000]) for _ in range(900)}
    for n in (31, 32, 33, 62, 63, 64, 65, 200, 3000):
        word = "".join(draw.choice(letters) for _ in range(n))
        for k, other in enumerate([word, *draw.sample(sorted(edits(word, letters)), 4)]):
            counts[other] = 2 + k * 30
    counts |= {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 50, "ÿÿÿÿÿÿÿ": 2, "zzzzzzz": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = spelling.forms(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == brute_forms(counts, letters) and len(got) == len(counts)
    assert spelling.forms(words.limit(0)).count() == 0


def test_affected_grams():
    """One edit leaves one of the two grams of a look-up where the other word has it."""
    draw = random.Random(6)
    letters = "abc"
    words = ["".join(draw.choice(letters) for _ in range(n)) for n in range(7, 25) for _ in range(8)]
    marked = spelling.Marked.of(words)
    grams = [c for _, code, fits in marked.codes() for c in code[fits].tolist()]
    often = Counter(grams)
    known = np.array(sorted(g for g, n in often.items() if n > 6), np.uint64)
    dictionary = known, np.array([often[g] for g in known.tolist()])
    for word in words:
        one = spelling.Marked.of([word])
        bound = spelling.longest_gram(np.array([len(word)]))
        size, gram, count = spelling.decompose(one, bound, dictionary)
        pair = [int(p[0]) for p in spelling.rarest_two(one, size, count)]
        assert pair[0] + size[pair[0]] <= pair[1]
        for other in draw.sample(sorted(edits(word, letters)), 20):
            if len(other) < len(word):
                continue
            size_2, gram_2, _ = spelling.decompose(spelling.Marked.of([other]), bound, dictionary)
            more = len(other) - len(word)
            assert any(gram[p] == gram_2[q] and size_2[q] for p in pair for q in {p, p + more})


def test_crc_of_spans():
    data = np.frombuffer(("é" * 300 + "abcdef").encode(), np.uint8)
    spans = [(0, 2), (0, 600), (3, 131), (600, 606), (5, 5)]
    begun = np.array([zlib.crc32(b"%d:" % k) for k in range(5)], np.uint32)
    got = spelling.crc_spans(data, *(np.array(x) for x in zip(*spans, strict=True)), begun)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + data[a:b].tobytes()) for k, (a, b) in enumerate(spans)]
