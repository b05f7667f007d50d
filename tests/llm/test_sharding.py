import random
import zlib
from collections import defaultdict

import numpy as np

from recordmill.llm import sharding as P


def greedy(sizes, capacity):
    shards, filled = 1, 0
    for s in sizes:
        if filled + s > capacity:
            shards, filled = shards + 1, 0
        filled += s
    return shards


def test_smallest_capacity_equals_brute_force():
    draw = random.Random(3)
    for _ in range(40):
        cells = sorted(draw.sample(range(-50, 50), draw.randrange(1, 20)))
        parts, inside = [], {}
        for c in cells:
            for _ in range(draw.choice([0, 0, 1])):
                parts.append((c, 0, draw.randrange(1000), draw.randrange(50, 200)))
            own = sorted((draw.randrange(-500, 500), draw.randrange(1, 30)) for _ in range(draw.randrange(1, 6)))
            own = list({h: (h, s) for h, s in own}.values())
            parts.append((c, 1, -(2**63), sum(s for _, s in own)))
            inside[c] = own
        parts.sort(key=lambda p: (p[0], p[1], p[2]))
        atoms = P.Atoms(*(np.array(x, np.int64) for x in zip(*parts, strict=True)))
        order = []
        for c, light, key, total in parts:
            order += [((c, 1, h), s) for h, s in inside[c]] if light else [((c, 0, key), total)]
        sizes, shards = [s for _, s in order], draw.randrange(1, 8)

        def fetch(wanted, atoms=atoms, inside=inside):
            for k in wanted:
                own = inside[int(atoms.cell[k])]
                atoms.inside[k] = np.array([h for h, _ in own]), atoms.starts[k] + np.cumsum([s for _, s in own])

        capacity, cuts = P.smallest_capacity(atoms, shards, max(sizes), fetch)
        best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
        assert capacity == best
        filled = defaultdict(int)
        for key, s in order:
            filled[sum(key >= c for c in cuts)] += s
        assert max(filled.values()) <= best and len(cuts) < shards


def test_shards(spark, edge_docs):
    draw = random.Random(9)
    texts = ["x" * draw.randrange(1, 400) for _ in range(60)] + ["same" * 2000] * 30
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame, shards in [(docs, 5), (edge_docs, 4)]:
        want = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        got = P.minimax_shards(frame, shards).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
            (d is None, d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in want
        )
        slots, homes = defaultdict(list), defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            homes[r["text_crc32"]].add(r["shard"])
        assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(h) == 1 for h in homes.values())
    sizes = defaultdict(int)
    for r in P.minimax_shards(docs, 5).collect():
        sizes[r["shard"]] += r["size"]
    alone = 30 * (8000 + 16)
    rest = [s for s in sizes.values() if s != alone]
    assert alone in sizes.values() and len(rest) == 4 and max(rest) - min(rest) <= 2 * (400 + 16) * 4
    assert P.minimax_shards(docs.limit(0), 5).count() == 0
