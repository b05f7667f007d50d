import random

import pytest
from pyspark.sql import functions as F

from recordmill.operators import taxonomy as T


def descendants(parents, node):
    out, open_ = {node}, [node]
    children = {}
    for n, p in parents.items():
        if p != n:
            children.setdefault(p, []).append(n)
    while open_:
        for c in children.get(open_.pop(), []):
            out.add(c)
            open_.append(c)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_intervals(spark, shape):
    rng = random.Random(5)
    nodes = list(range(1, 120))
    rng.shuffle(nodes)
    parents = {nodes[0]: None, nodes[1]: nodes[1], nodes[2]: 10**6}  # three kinds of roots
    for k, n in enumerate(nodes[3:], 3):
        parents[n] = {"random": rng.choice(nodes[:k]), "chain": nodes[k - 1], "star": nodes[0]}[shape]
    table = spark.createDataFrame(list(parents.items()), "node bigint, parent bigint")
    rows = {r["node"]: (r["low"], r["high"]) for r in T.number_taxa(table).collect()}
    assert sorted(low for low, _ in rows.values()) == list(range(len(parents)))
    for n in parents:
        low, high = rows[n]
        assert {m for m, (at, _) in rows.items() if low <= at < high} == descendants(parents, n)


def test_circle_and_empty(spark):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node bigint, parent bigint")
    with pytest.raises(ValueError):
        T.number_taxa(circle)
    assert T.number_taxa(circle.limit(0)).count() == 0


def test_bits(spark):
    rows = [(1, [0b101, 1 << 31]), (1, [0b010]), (2, None), (2, []), (3, [0, 0, 7])]
    df = spark.createDataFrame(rows, "key int, bits array<bigint>")
    got = df.select(T.member("bits", 0), T.member("bits", 63), T.members_any("bits", [1, 65]), T.members_all("bits", [0, 2])).collect()
    assert [tuple(r) for r in got] == [
        (True, True, False, True), (False, False, True, False), (False,) * 4, (False,) * 4, (False, False, True, False),
    ]
    assert {r["key"]: r["bits"] for r in T.union_members(df, "key", "bits").collect()} == {1: [7, 1 << 31], 2: [], 3: [0, 0, 7]}
    assert {r["k"]: r["records"] for r in T.member_counts(df, "bits").collect()} == {0: 1, 1: 1, 2: 1, 63: 1, 64: 1, 65: 1, 66: 1}
    made = df.select(T.bit_array(F.array(F.lit(0), F.lit(33), F.lit(63)), 2).alias("b")).first()["b"]
    assert made == [1, 2 | 1 << 31]


def test_below_with_unknown_taxa(spark):
    numbered = T.number_taxa(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node bigint, parent bigint"))
    records = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9), ("d", None)], "id string, taxid bigint")
    ids = lambda taxa: sorted(r["id"] for r in T.below(records, "taxid", numbered, taxa).collect())
    assert ids([2]) == ["a"] and ids([1, 3]) == ["a", "b"] and ids([9]) == [] and ids([]) == []
