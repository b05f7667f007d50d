import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from recordmill.llm import prefixtrie


def brute(conversations):
    """conversations: id to list of (role, text)."""
    nodes = defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[c] for c in children[key]) or 1
        own = (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        saved[key] = own + sum(saved[c] for c in children[key])
    rows = set()
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(conversations[c]) == len(key)))
        rows.add((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children[key]),
            leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def built(turns):
    nodes = prefixtrie.build(*prefixtrie.borrowed_heads(turns))
    got = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie(spark):
    draw = random.Random(8)
    own = {}
    for c in [*range(100, 160), 0, 7, 333, 250, 1201, 1200]:
        own[c] = [(draw.choice(["user", "assistant", ""]), draw.choice(["a", "bé", "", "long text " * 3])) for _ in range(draw.randint(1, 11))]
    deep = [("user", f"turn {k}") for k in range(90)]
    own |= {500: deep, 501: deep, 502: deep[:41], 503: deep[:43] + [("user", "other")], 504: deep[:44] + deep[:3]}
    own |= {c: deep[: c - 590] + [("x", str(c))] for c in range(601, 640)}  # chains that hang on one another
    rows = [(c, k * 3, r or None, t or None, "x", 1) for c, turns in own.items() for k, (r, t) in enumerate(turns)]
    rows.append((None, 1, "user", "no id", "x", 1))
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string, block int").repartition(6)
    assert built(prefixtrie.ordered_turns(table)) == brute(rebuilt(own))


def test_staircase(spark):
    """Every chain hangs on the one before: several rounds of doubling."""
    own = {c: [("u", str(k)) for k in range(c)] + [("u", f"end {c}")] for c in range(1, 40)}
    own = {1000 * c: turns for c, turns in own.items()}
    rows = [(c, k, r, t) for c, turns in own.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert built(prefixtrie.ordered_turns(table)) == brute(rebuilt(own))


def test_ties_and_nulls(spark):
    rows = [(1, None, "user", "x"), (1, None, "user", "x"), (1, 5, None, None), (1, 5, "a", "b"), (1, -3, "user", "first"), (2, 1, None, "")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    turns = prefixtrie.ordered_turns(table)
    got = [r["chars"] for r in turns.where("conv_id = 1").orderBy("at").collect()]
    assert got[:3] == [1, 1, 5] and sorted(got[3:]) == [0, 1]
    again = prefixtrie.ordered_turns(table.repartition(3)).orderBy("conv_id", "at").collect()
    assert again == turns.orderBy("conv_id", "at").collect()


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert built(prefixtrie.ordered_turns(table)) == set()


@pytest.mark.parametrize("count", [1, 3])
def test_turnless(spark, count):
    rows = [(c, 0, "user", "gone") for c in (c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 > 0)][:count]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert built(prefixtrie.ordered_turns(table)) == brute({c: [] for c, *_ in rows})
