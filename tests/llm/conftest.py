import random

import pytest

WORDS = "the of and to in is that for it with as was on be at by this had not are but from or have an they which one".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with names used inside."""
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))
    base = text(60)
    near = base.split()
    near[3] = "other"
    rows = [
        (0, base, "en", "a"),
        (1, " ".join(near), "en", None),
        (2, None, None, None),
        (3, "", "fr", "b"),
        (4, "?!  ...\n\n", None, "b"),
        (5, text(60_000), "en", "c"),
        (6, base, None, "a"),
        (6, base, None, "a"),
        (7, "one two", "fr", "b"),
        (8, "ONE two", "fr", "b"),
        (9, text(900) + " call +1 (017) 555-7713 or mail a.b@c.example.org", "en", "b"),
        (10, "<|endoftext|>  x y  z\n w\t<|endoftext|>", "de", "b"),
        (None, "no id here", "en", "b"),
    ]
    rows = [(*r, len(r[1] or ""), k, k, "x") for k, r in enumerate(rows)]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, hash int, bucket int, component_id string"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def benchmark(spark, edge_docs):
    words = edge_docs.where("doc_id = 5").first()["text"].split()
    rows = [
        (1, " ".join(words[100:130])),
        (2, " ".join(words[120:150]).upper()),
        (3, "one TWO"),
        (4, None),
        (5, ""),
        (6, "nothing of this is anywhere in the documents of these tests at all"),
        (7, " ".join(words[100:130])),
        (None, "no id here"),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")
