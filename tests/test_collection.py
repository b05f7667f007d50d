import random
import re

import pytest
from pyspark.sql import functions as F

from recordmill.sources.collection import Collection, write_collection

RNG = random.Random(5)
ROWS = [(f"r{k:03}", RNG.choice(["hot", "hot", "cold", None]), "".join(RNG.choice("ACGT-") for _ in range(RNG.randint(0, 90)))) for k in range(200)]
ROWS += [("empty", "cold", ""), ("none", None, None)]
SIZE = {k: len(re.sub("[^A-Za-z]", "", t or "")) for k, _, t in ROWS}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id string, kind string, body string").repartition(5)
    names = F.array("kind", F.concat(F.lit("n"), "id"), F.concat(F.lit("n"), "id"))
    path = str(tmp_path_factory.mktemp("collection") / "c")
    return write_collection(df.withColumn("names", names), path, names="names", volume_letters=1000, buckets=6)


def volumes():
    before, out = 0, {}
    for key in sorted(SIZE):
        out[key] = before // 1000
        before += SIZE[key]
    return out


def test_volumes(stored):
    want = volumes()
    assert {r["id"]: r["volume"] for r in stored.records.collect()} == want
    ranked = sorted(SIZE)
    for row in stored.volumes.collect():
        held = [k for k in ranked if want[k] == row["volume"]]
        assert (row["records"], row["letters"], row["longest"]) == (len(held), sum(SIZE[k] for k in held), max(SIZE[k] for k in held))
        assert (ranked[row["first_position"]], ranked[row["last_position"]]) == (held[0], held[-1])


def test_all_columns_stay(stored):
    assert {(r["id"], r["kind"], r["body"]) for r in stored.records.collect()} == set(ROWS)


def test_lookup_of_ids_opens_their_buckets(stored):
    found = stored.fetch(["r001", "none", "absent"])
    assert sorted(r["id"] for r in found.collect()) == ["none", "r001"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert opened(found) < opened(stored.records) / 2


def opened(df):
    """Number of files that the scan of a plan without exchange opens."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    parts = scan.inputRDDs().apply(0).filePartitions()
    return sum(len(parts.apply(i).files()) for i in range(parts.size()))


def test_batch_fetch_leaves_the_collection_in_place(stored, spark):
    stored.write_alias("plan", [0, 1], ids=spark.createDataFrame([("r001",), ("r040",), (None,)], "k string"))
    wanted = spark.createDataFrame([("r001",), ("r001",), (None,), ("absent",), ("r100",)], "k string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stored.fetch(wanted, "plan")
        assert [r["id"] for r in found.collect()] == ["r001"]
        final = stored.fetch(wanted, "plan")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert final.count("Exchange") == 1 and "REPARTITION_BY_NUM" in final
    assert final.count("Bucketed: true") == 2


def test_aliases(stored, spark):
    place, kind = volumes(), {k: v for k, v, _ in ROWS}
    hot = spark.createDataFrame([(k,) for k in kind if kind[k] == "hot"], "k string")
    odd = spark.createDataFrame([(k,) for k in kind if k[-1] in "13579"], "k string")
    stored.write_alias("hot", [1, 2], ids=hot)
    stored.write_alias("both", [2, 3, "hot"])
    stored.write_alias("odd", ["both", 0], ids=odd)
    stored.write_alias("nothing", [])
    in_hot = {k for k in place if place[k] in (1, 2) and kind[k] == "hot"}
    in_both = in_hot | {k for k in place if place[k] in (2, 3)}
    in_odd = {k for k in in_both | {k for k in place if place[k] == 0} if k[-1] in "13579"}
    for name, want in (("hot", in_hot), ("both", in_both), ("odd", in_odd), ("nothing", set())):
        got = [r["id"] for r in stored.alias(name).collect()]
        assert len(got) == len(set(got)) and set(got) == want, name
    assert stored.alias("odd").columns == stored.records.columns
    for call in (lambda: stored.write_alias("hot", [1]), lambda: stored.write_alias("x", ["y"]), lambda: stored.alias("y")):
        with pytest.raises(ValueError):
            call()


def test_names(stored):
    got = sorted(tuple(r) for r in stored.lookup(["hot", "nr007", "absent"]).collect())
    assert got == sorted([("hot", k) for k, kind, _ in ROWS if kind == "hot"] + [("nr007", "r007")])


def test_a_name_of_many_records_fills_several_buckets(stored):
    files = stored._table("names").where("name = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_opened_again(stored, spark):
    want = {tuple(r) for r in stored.records.select("id", "volume").collect()}
    for part in ("records", "names"):
        spark.sql(f"DROP TABLE {stored._name(part)}")
    again = Collection.open(spark, stored.path)
    assert {tuple(r) for r in again.records.select("id", "volume").collect()} == want
    assert opened(again.fetch(["r001"])) < opened(again.records) / 2
    assert again.lookup(["nr007"]).count() == 1


def test_refusals(spark, tmp_path):
    for rows in ([("a", "x"), ("a", "y")], [("a", "x"), (None, "y")]):
        with pytest.raises(ValueError):
            write_collection(spark.createDataFrame(rows, "id string, body string"), str(tmp_path / "c"))
        assert not (tmp_path / "c").exists()
    with pytest.raises(ValueError):
        write_collection(spark.createDataFrame([("a", "x", 1)], "id string, body string, volume int"), str(tmp_path / "c"))


def test_empty(spark, tmp_path):
    stored = write_collection(spark.createDataFrame([], "id string, body string"), str(tmp_path / "c"))
    assert stored.records.count() == 0 and stored.volumes.count() == 0 and stored.fetch(["a"]).count() == 0
