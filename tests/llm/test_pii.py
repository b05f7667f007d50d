import re
from itertools import combinations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from recordmill.llm import pii as P

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    spans = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = [True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(digits) <= 19, 9 <= len(digits) <= 15][kind]
            if kind == 2 and fine:
                total = 0
                for k, d in enumerate(map(int, reversed(digits))):
                    d = 2 * d if k % 2 else d
                    total += d - 9 if d > 9 else d
                fine = total % 10 == 0
            if fine:
                spans.append((kind, *m.span()))
    return spans


@given(st.lists(st.sampled_from(list("01259.@-+ ()ab%é") + ["4111111111111111", "192.168.0.1", "a@b.co", "+1 (017) 555-7713"]), max_size=30))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert sorted(P.base_spans(text)) == sorted(plain(text))


SAMPLE = [
    "the mail is joe.b@mail4.example.com and of",
    "an onha +1 (017) 555-7713 rethsh on",
    "mente 97.51.17.173 ueadoos it is",
    "ais 4111111111111111 in the",
    "pour 9807915762804491 en esarbo",
    'and token = "04dbebab91ab85687d33" with',
    "in 2024 the 12 of 350.2 and",
    "write to a90@mail2.example.com de la",
    "call +44 (974) 555-3436 then",
    "from 123.190.179.76 erble, 300.1.2.3 no",
] * 12


def test_field_learns_and_adds_forms():
    weights = P.train(SAMPLE)
    found = lambda text: [(P.KINDS[k], text[a:b]) for k, a, b in sum(P.find(text, weights), [])]
    assert found("so joe.b[at]mail4.example.com and") == [("email", "joe.b[at]mail4.example.com")]
    assert found("so (017) 555-7713 and") == [("phone", "(017) 555-7713")]
    for clean in ("in 2024 the 12 of", 'token = "04dbebab91ab85687d33"', "9807915762804491 en", "", "no trigger"):
        assert found(clean) == []


def test_long_names_and_domains_are_whole():
    weights = P.train(SAMPLE + ["the mail is joe.bb@mail4.example.com and of"] * 24)  # of even length: taught with (at)
    shown = lambda text: P.redact(text, sum(P.find(text, weights), []))
    names = ["firstname.middlename.lastname", "a" * 23, "b" * 24, "c" * 25, "x" * 300]
    domains = ["mail2.example.org", "mail.department.example-university.edu", "y" * 300 + ".example.com"]
    for name in names:
        for domain in domains:
            for sign in ("[at]", " (at) "):
                if len(P._TOKEN.findall(name + sign + domain)) <= P.MAX_TOKENS:
                    assert shown(f"so {name}{sign}{domain} and") == "so <EMAIL> and", (name, sign, domain)


def test_chains_of_triggers_are_decoded_whole():
    weights = P.train(SAMPLE)
    for filler in range(4040, 4110):
        text = "4 " * (filler // 2) + " " * (filler % 2) + "joe.b[at]mail4.example.com and"
        assert [text[a:b] for k, a, b in P.find(text, weights)[1] if k == 0] == ["joe.b[at]mail4.example.com"], filler
    # Blocks of tokens change nothing.
    draw, text = np.random.default_rng(4), "a 12 b@c.d +1 2, joe[at]x.org\n" * 12
    whole = P.BLOCK
    for _ in range(5):
        weights = draw.normal(size=(len(P.KINDS), P._WIDTH)) + 0.4
        want = P.decode(text, weights)
        try:
            P.BLOCK = 7
            assert P.decode(text, weights) == want
        finally:
            P.BLOCK = whole


def test_stretches_cut_no_run():
    draw = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(draw.choice(list("ab.-é  ,[@7"), 400, p=[0.3, 0.3, 0.1, 0.05, 0.1, 0.05, 0.05, 0.01, 0.01, 0.01, 0.02]))
        found = list(P.stretches(text))
        assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        inside = {k for a, b in found for k in range(a, b)}
        for m in P._TRIGGER.finditer(text):
            assert inside >= set(range(max(m.start() - P.MARGIN, 0), min(m.end() + P.MARGIN, len(text))))
        for m in P._RUN.finditer(text):
            assert len(inside & set(range(*m.span()))) in (0, m.end() - m.start())


def test_dynamic_programming_equals_all_segmentations():
    draw = np.random.default_rng(3)
    text = "a 12 b@c.d +1 2"
    for _ in range(20):
        weights = draw.normal(size=(len(P.KINDS), P._WIDTH)) + 0.4
        bounds, segments = P.candidates(text)
        score = P._scores(segments, weights) - P.MARGIN_SCORE
        best = 0.0
        for n in range(1, 5):
            for chosen in combinations(range(len(segments)), n):
                ends = sorted(segments[s][:2] for s in chosen)
                if all(x[1] <= y[0] for x, y in zip(ends, ends[1:])):
                    best = max(best, sum(score[s].max() for s in chosen))
        place = {(bounds[i], bounds[j]): k for k, (i, j, _) in enumerate(segments)}
        got = sum(score[place[a, b], k] for k, a, b in P.decode(text, weights))
        assert abs(got - best) < 1e-9


def test_expectations_sum_over_all_segmentations():
    ends, scores = [(0, 1), (0, 2), (1, 3), (2, 3)], np.random.default_rng(1).normal(size=(4, 2))
    total, mass = 0.0, np.zeros_like(scores)
    for n in range(4):
        for chosen in combinations(range(4), n):
            spans = sorted(ends[s] for s in chosen)
            if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                for kinds in np.ndindex(*[2] * n):
                    weight = np.exp(sum(scores[s, k] for s, k in zip(chosen, kinds)))
                    total += weight
                    for s, k in zip(chosen, kinds):
                        mass[s, k] += weight
    assert np.allclose(P._expected(3, ends, scores), mass / total)


def test_documents(edge_docs):
    weights = P.learn(edge_docs)
    for r in P.annotate(edge_docs, weights).collect():
        base = [tuple(s) for s in r["__base"]]
        assert base == sorted(plain(r["text"] or "")) and set(base) <= {tuple(s) for s in r["__spans"]}
    redacted = P.redacted(edge_docs, weights)
    assert redacted.columns == edge_docs.columns and redacted.count() == edge_docs.count()
    text = redacted.where("doc_id = 9").first()["text"]
    assert text.endswith("call <PHONE> or mail <EMAIL>") and not plain(text)
    assert P.annotate(edge_docs.limit(0), weights).count() == 0
