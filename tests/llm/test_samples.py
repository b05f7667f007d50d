from recordmill.llm import pii as P
from recordmill.llm.samples import smallest_hashes


def test_repeated_rows_do_not_shorten_the_sample(spark):
    # One value of 50,000 rows, and 400 others: the bound must follow the different ones.
    df = spark.range(50_400).selectExpr("greatest(id - 50000, 0) AS value", "id - 50000 IN (7, 8, 9) AS rare")
    want = [r["value"] for r in df.distinct().selectExpr("value", "xxhash64(value) AS h").orderBy("h").limit(100).collect()]
    assert [r["value"] for r in smallest_hashes(df.select("value"), 100, "value").collect()] == want
    assert smallest_hashes(df.select("value"), 1000, "value").count() == 400
    got = {r["value"] for r in smallest_hashes(df, 100, "value", also={"rare": 3}).collect()}
    assert got == {*want, 7, 8, 9}
    assert smallest_hashes(df.limit(0), 100, "value", also={"rare": 3}).count() == 0


def test_rare_kinds_are_taught(spark):
    # 4,000 different stretches, of which two hold a mail address, and many copies of one.
    rows = [(f"in {k} the",) for k in range(4000)] + [("in 2024 the",)] * 4000
    rows += [("write to a90@mail2.example.com de la",), ("write to joe.b@mail4.example.org or",)] * 2
    weights = P.learn(spark.createDataFrame(rows, "text string"), sample=40)
    assert weights[0, P._NAMES.index("dotted_domain")] > 0
