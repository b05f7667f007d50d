import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from recordmill.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a b", "a  b", "a\n b", "a \n b", "x<|endoftext|> y <|endoftext|>  z", "it's we'll  I'm", "é\u00a0b \u00a0c",
    "a\u3000 b", "\u2003 a b\u2003 c", "tab\tsep \t x", "12 345  6", "naïve ’s 😀 😀x", "\x1c a \x1c b", "end ", " start", "a\u0085 b c", "x<|endoftext|>'s, y’s\u2009z\u2009, é, à b è. ×, a÷, 1,2 \x1cb\x1f c\x7f d",
    "don't, (x) [y] a\u0301, b", "a\u200a\u200a b", "<|endoftext|><|endoftext|> a<|endoftext|", "\u1680a \u205f b", "中文, 1。",
]


def test_ids_equal_the_tokenizer(spark):
    coder, plain = P.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), 0), Tokenizer.from_file(PATH)
    for texts in (HARD, HARD[::-1] * 3):
        ids, first = coder.encode(pa.chunked_array([texts], pa.string()))
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids + [0], text


def check(pieces, want, window=1024):
    """Every id in exactly one piece, sequences gapless, and no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    places = defaultdict(int)
    for r in pieces:
        for k in range(r["start"], r["start"] + r["length"]):
            places[r["doc_id"], k] += 1
    expected = defaultdict(int)
    for doc, ids in want:
        for k in range(len(ids)):
            expected[doc, k] += 1
    assert places == expected
    known = defaultdict(set)
    for doc, ids in want:
        for r in by_doc[doc, len(ids)]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            known[doc, r["start"], r["length"]].add(zlib.crc32(part.tobytes()))
    assert all(r["ids_crc32"] in known[r["doc_id"], r["start"], r["length"]] for r in pieces)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        end = 0
        for r in parts:
            assert r["offset"] == end
            end += r["length"]
        assert end <= window and end & (end - 1) == 0


def test_pieces(spark, edge_docs):
    plain = Tokenizer.from_file(PATH)
    hard = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "doc_id bigint, text string")
    for docs in (edge_docs, hard):
        want = [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
        check(P.pack(docs).collect(), want)
    assert P.pack(edge_docs.limit(0)).count() == 0


def test_index_equals_the_formula():
    draw = np.random.default_rng(8)
    ids = [draw.integers(0, 30, draw.integers(1, 40)) for _ in range(20)]
    idf, mean = draw.random(30), 21.0
    index = P.Index(ids, idf, mean)
    query = ids[4]
    for k, score in enumerate(index.scores(query)):
        own = ids[k].tolist()
        want = sum(
            idf[t] * own.count(t) * (P.K1 + 1) / (own.count(t) + P.K1 * (1 - P.B + P.B * len(own) / mean))
            for t in set(query.tolist())
        )
        assert abs(score - want) < 1e-9


def test_neighbours_share_a_window():
    left, right = np.arange(100, 400), np.arange(500, 800)
    ids = [left, right, left[:200], right[:200], left[:524], right[:524]]
    ids = [x.astype("<u4") for x in (left[:300], right[:300], left[:260], right[:260])]
    placed = P.fill(ids, np.ones(1000), 280.0, 512)
    together = defaultdict(list)
    for piece, _, length, sequence, _ in placed:
        together[sequence].append((piece, length))
    assert together[0] == [(0, 300), (2, 212)] and together[1][:2] == [(1, 300), (3, 212)]


def test_rarest_token_of_a_batch_at_once(spark, monkeypatch):
    """Pieces are keyed by their rarest token, equally rare ones by the smallest, without a sort of each piece."""
    rng = np.random.default_rng(5)
    idf = np.round(rng.random(40), 1)
    tails = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u4") for _ in range(300)]
    want = [min(t.tolist(), key=lambda i: (-idf[i], i)) for t in tails]
    monkeypatch.setattr(np, "lexsort", None)
    assert P.rarest(pa.array([t.tobytes() for t in tails], pa.binary()), P.rarity(idf)).tolist() == want
