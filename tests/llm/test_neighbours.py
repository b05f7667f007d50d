import numpy as np

from recordmill.llm import neighbours as N


def brute(rows, query, k):
    vector = dict(rows)[query]
    far = [(float(np.sqrt(((np.array(v) - vector) ** 2).sum())), i) for i, v in rows if i != query and len(v) == len(vector)]
    return [i for _, i in sorted(far)[:k]]


def test_recall_ties_and_bad_vectors(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 24))
    rows = [(k, (centres[k % 6] + 0.4 * draw.normal(size=24)).astype(np.float32).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[0][1]) for k in range(300)]  # many equal vectors
    bad = [(3000, None), (3100, [0.0] * 24), (3200, [None] + [1.0] * 23), (3300, [float("nan")] * 24), (3400, [float("inf")] * 24)]
    short = [(4000, [1.0, 2.0]), (4100, [1.0, 2.5])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + bad + short], "vec_id bigint, embedding array<float>, rank int, score double")
    got = {}
    for r in N.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r)
    good = rows + short
    assert set(got) == {i for i, _ in good if i % 100 == 0}
    hit = total = 0
    for query, found in got.items():
        found.sort(key=lambda r: r["rank"])
        want = brute(good, query, 10)
        assert [r["rank"] for r in found] == list(range(1, len(want) + 1))
        assert found == sorted(found, key=lambda r: (r["score"], r["vec_id"]))
        hit, total = hit + len({r["vec_id"] for r in found} & set(want)), total + len(want)
    assert hit / total >= 0.9
    assert [r["vec_id"] for r in got[0]] == list(range(2000, 2010))
    assert [(r["vec_id"], r["score"]) for r in got[4000]] == [(4100, 0.5)]
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chi_square_radius():
    assert abs(N.radius(0.95, 8) - 15.507) < 1e-2 and abs(N.radius(0.99, 10) - 23.209) < 1e-2


def test_leaves_come_in_order_and_complete():
    points = np.random.default_rng(2).normal(size=(700, 4))
    points[:200] = points[0]
    tree, seen, last = N.Tree(points), [], -1.0
    for bound, members in tree.leaves(np.zeros(4)):
        assert bound >= last and ((points[members] ** 2).sum(axis=1) >= bound - 1e-9).all()
        last = bound
        seen += members.tolist()
    assert sorted(seen) == list(range(700))
