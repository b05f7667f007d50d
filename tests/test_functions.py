import pytest
from pyspark.sql import functions as F

from recordmill.functions import residues as R
from recordmill.functions import text as T
from recordmill.functions.codec import compress, inflate
from recordmill.functions.options import positive_int, split_words
from recordmill.operators.similarity import de_bruijn, distinct_words
from recordmill.sources.tables import matrix_scores


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "s STRING")
    return [r[0] for r in df.select(column(F.col("s"))).collect()]


def test_record_id(spark):
    assert values(spark, T.record_id, [">a one", "> b", ">", "x y"]) == ["a", "b", None, "x"]


def test_counts(spark):
    bodies = ["MKV\nLL\n", "MK*-\n", "M K\n", None]
    assert values(spark, T.letter_count, bodies) == [5, 2, 2, -1]
    assert values(spark, T.residue_count, bodies[:3]) == [5, 4, 2]
    assert values(spark, T.nonspace_count, ["M\x0bK\f\n", "é é"]) == [2, 2]
    assert values(spark, T.byte_length, ["é"]) == [2]
    assert values(spark, lambda c: T.char_count(c, ","), ["a,b,,", ""]) == [3, 0]


def test_clip_id(spark):
    assert values(spark, T.clip_id, ["gi|", "gi|5", "gi|5|ref|x", "abc", "ref|A|b"]) == ["gi", "5", "5", "abc", "ref"]
    assert values(spark, lambda c: T.clip_id(c, force=True), ["abc", "sp|P|"]) == ["", "sp"]


def test_clip_organism(spark):
    assert values(spark, T.clip_organism, ["a ] [b]", "[[x] y]", "[open"]) == ["b", "[x", ""]


def test_query_name(spark):
    df = spark.createDataFrame([("gi|11|x", "d"), (None, "  first word"), (None, None)], "a STRING, b STRING")
    assert [r[0] for r in df.select(T.query_name("a", "b")).collect()] == ["11", "first", None]


def test_gi_token_and_keys(spark):
    assert values(spark, T.gi_token, [">gi|7|x", ">plain name"]) == ["7", "plain"]
    long = "é" * 20 + "\nrest"
    assert [bytes(v) for v in values(spark, T.recovery_key, [long, "one line"])] == [long.encode()[:32], b"one line"]
    assert bytes(values(spark, T.recovery_key_flat, ["a\nb\rc"])[0]) == b"a b c"


def test_deflines(spark):
    header = ">gi|1|ref|A| one [Homo]\x01gi|2|sp|B| two"
    (found,) = values(spark, T.deflines, [header])
    assert [tuple(d) for d in found] == [("1", "ref", "A", "one [Homo]", "Homo"), ("2", "sp", "B", "two", "")]


def test_translate_and_strands(spark):
    assert values(spark, R.translate_codons, ["ATGGCCTAA", "ATGNNN", "AUGG"]) == ["MA*", "MX", "M"]
    assert values(spark, lambda c: R.translate_codons(c, 2), ["AGA"]) == ["*"]
    assert values(spark, lambda c: R.translate_codons(c, 1, frame=1), ["CATGG"]) == ["M"]
    assert values(spark, R.reverse_complement, ["AACG"]) == ["CGTT"]
    assert values(spark, lambda c: R.subsequence(c, 2, 3), ["ABCDE"]) == ["BC"]
    assert values(spark, lambda c: R.subsequence(c, 0, 0), ["ABCDE"]) == ["ABCDE"]
    assert values(spark, lambda c: R.wrap_lines(c, 2), ["ABCDE"]) == ["AB\nCD\nE"]
    codes = R.genetic_code_table(spark)
    assert codes.count() == 17 * 64
    assert codes.where("code_id = 1 AND codon = 'ATG' AND aa = 'M' AND is_start").count() == 1


def test_allowed_position(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i INT")
    ranges = F.array(F.struct(F.lit(1).alias("left"), F.lit(4).alias("right")), F.struct(F.lit(7).alias("left"), F.lit(9).alias("right")))
    assert [r.i for r in df.where(R.allowed_position(F.col("i"), 2, ranges)).collect()] == [1, 2, 7]


def test_matrix_reader(spark, tmp_path):
    path = tmp_path / "matrix"
    path.write_text("# note\n   A  R  *\nA  4 -1 -4\nR -1  5 -4\n* -4 -4  1\n")
    scores = matrix_scores(spark, str(path))
    assert scores[("A", "R")] == -1 and scores[("*", "*")] == 1 and len(scores) == 9
    df = spark.createDataFrame([("A", "R"), ("A", "?")], "a STRING, b STRING")
    assert [r[0] for r in df.select(R.substitution_score(F.col("a"), F.col("b"), scores, -4)).collect()] == [-1, -4]


def test_zlib(spark):
    df = spark.createDataFrame([(b"abc" * 100,), (None,)], "b BINARY")
    out = df.select(inflate(compress("b")).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in out] == [b"abc" * 100, None]


def test_split_words():
    assert split_words("search -d 'my db' -o \"a b\"c  x") == ["search", "-d", "my db", "-o", "a bc", "x"]
    assert split_words("a 'open") == ["a"]
    assert split_words("  ") == []


@pytest.mark.parametrize("bad", ["0", "-1", "3x", "", "1.5"])
def test_positive_int(bad):
    assert positive_int(" 12") == 12
    with pytest.raises(ValueError):
        positive_int(bad)


def test_de_bruijn():
    words = list(distinct_words("ACG", 3))
    assert len(de_bruijn("ACG", 3)) == 27 and len(set(words)) == 27


def test_text_runs():
    import pyarrow as pa

    texts = ["abc", "", "é" * 4, "x" * 30, "", "ab", "abcdefgh"]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
    runs = [r.column(0).to_pylist() for r in T.text_runs(batch, "text", 10)]
    assert runs == [["", "é" * 4], ["x" * 30], ["", "ab", "abcdefgh"]]
    assert [len(r) for r in T.text_runs(batch.slice(0, 0), "text", 10)] == []
