import numpy as np

from recordmill.llm import cotraining as C

TABLES = "/root/testdata/sf0.1"


def test_held_back_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    scored = C.score(docs, C.learn(docs, half)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = scored.select((C.F.col("kept")).alias("kept"), labels["quality"], labels["toxic"]).collect()
    right = [r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows]
    assert len(rows) > 1000 and np.mean(right) > 0.93
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r["kept"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.1


def test_edge_rows(spark, edge_docs):
    rows = edge_docs.selectExpr("*", "1 AS quality", "'x' AS toxic")
    labels = spark.createDataFrame(
        [(0, 1, 0), (2, 0, 0), (3, 0, 1), (5, 1, 0), (9, 1, None), (77, 1, 1), (0, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int"
    )
    for given in (labels, labels.limit(0)):
        got = C.score(rows, C.learn(rows, given)).collect()
        assert len(got) == edge_docs.count()
        assert all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
    assert C.score(rows.limit(0), C.learn(rows.limit(0), labels)).count() == 0


def test_views_teach_each_other():
    draw = np.random.default_rng(5)
    truth = draw.integers(0, 2, 600)
    first = C._rows(np.arange(600) * 40 + truth * 20 + draw.integers(0, 20, 600), 40, 600)
    second = C._rows(np.arange(600) * 40 + truth * 20 + draw.integers(0, 20, 600), 40, 600)
    labels = np.full(600, -1)
    labels[:30] = truth[:30]

    def right(rounds):
        models, beta = C.co_train([first, second], [40, 40], labels, rounds, 0.6)
        margins = np.stack([C.margin(v, m) for v, m in zip((first, second), models)], axis=1)
        return np.mean((margins @ beta[:-1] + beta[-1] > 0) == (truth == 1))

    assert right(4) >= right(0) and right(4) > 0.9


def test_one_label_of_a_row_teaches_its_target(spark):
    # Toxic rows have no quality, and rows with a quality say nothing of toxicity but that it is 0.
    rows = [(k, f"vile hateful words {k}" if k % 2 else f"calm friendly words {k}", "s", "en", 30) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int")
    given = [(k, None, 1) if k % 2 else (k, 1, 0) for k in range(200)]
    labels = spark.createDataFrame(given, "doc_id bigint, quality int, toxic int")
    got = C.score(docs, C.learn(docs, labels)).where("doc_id >= 200").collect()
    assert all((r["toxic"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_rounds_over_all_documents(spark):
    """The tasks' counts give the models that all unlabelled rows in one place would give."""
    draw = np.random.default_rng(9)
    bad, good = [f"vile{k}" for k in range(30)], [f"kind{k}" for k in range(30)]
    rows = []
    for k in range(900):
        toxic = int(draw.random() < 0.3)
        text = " ".join([*draw.choice(bad if toxic else good, 3), *draw.choice([f"w{j}" for j in range(400)], 12)])
        rows.append((k, text, f"{'dark' if toxic else 'light'}{int(draw.integers(0, 3))}", "en", len(text), toxic))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int, truth int")
    labels = spark.createDataFrame([(r[0], 1 - r[5], r[5]) for r in rows[:150]], "doc_id bigint, quality int, toxic int")
    models = C.learn(table.drop("truth").repartition(7), labels)
    sample = C.featured(table).toArrow().sort_by("doc_id")
    views = C._views(sample)
    truth = np.array([r[5] if r[0] < 150 else -1 for r in rows])
    alone, beta = C.co_train(views, C._WIDTHS, truth)
    for (weights, bias), (other, middle) in zip(models["toxic"][0], alone, strict=True):
        assert np.allclose(weights, other) and np.isclose(bias, middle)
    assert np.allclose(models["toxic"][1], beta)
    before = C.co_train(views, C._WIDTHS, truth, 0)[0][0][0]
    assert (alone[0][0] != 0).sum() > (before != 0).sum()  # words that no labelled row has taught


def test_rounds_do_not_lower_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    views = C.materialize(C.featured(docs), "views")
    rest = labels.where("doc_id % 2 = 1").withColumnsRenamed({"quality": "q", "toxic": "t"})

    def right(rounds):
        C.co_train.__defaults__ = (rounds, *C.co_train.__defaults__[1:])
        rows = C.score(views, C.learn(views, labels.where("doc_id % 2 = 0"))).join(rest, "doc_id").collect()
        recall = np.mean([r["toxic"] > 0.5 for r in rows if r["t"] == 1])
        return np.mean([(r["toxic"] > 0.5) == r["t"] for r in rows]), recall

    (alone, _), (taught, recall) = right(0), right(C.ROUNDS)
    assert taught >= alone - 0.002 and recall > 0.8
