from pyspark.sql import functions as F

from qaspark.functions import text as T

# (input, tokenize, no_symbol) worked by hand from the normaliser rules.
CASES = [
    ("meet on May 5th 2010 at 10:30 pm for $ 3,000.50 or 20 %",
     "meet on DATE at TIME for MONEY or PRESENT",
     "meet on May 5th 2010 at 10 30 pm for 3 000 50 or 20 %"),
    ("born-in", "born-in", "born in"),
    ("ABC 12", "ABC 12", "ABC 12"),
    ("mail a.b@c.com now 5 ml", "mail EMAIL now MTC", "mail a b at c com now 5 ml"),
    ("the 3 rd of 4", "the NUM rd of NUM", "the 3 rd of 4"),
    ("it may rain", "it NUM rain", "it may rain"),
    ("", "", ""),
    ("UPPER CASE ONLY", "UPPER CASE ONLY", "UPPER CASE ONLY"),
    ("plain words here", "plain words here", "plain words here"),
]


def test_normalisers(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "s string")
    got = df.select("s", T.tokenize("s").alias("t"), T.no_symbol("s").alias("n")).collect()
    by = {r["s"]: (r["t"], r["n"]) for r in got}
    for raw, tok, nos in CASES:
        assert by[raw] == (tok, nos)


def test_split_ngrams_capitalize(spark):
    df = spark.createDataFrame([("  a b\tc  ",), ("",), ("x",)], "s string")
    r = df.select(T.split_ws("s").alias("t")).select(
        "t", T.ngrams(F.col("t"), 2).alias("g2"), T.ngrams(F.col("t"), 3).alias("g3")).collect()
    assert r[0]["t"] == ["a", "b", "c"] and r[0]["g2"] == ["a b", "b c"] and r[0]["g3"] == ["a b c"]
    assert r[1]["t"] == [] and r[1]["g2"] == []
    assert r[2]["g2"] == [] and r[2]["g3"] == []
    c = spark.createDataFrame([("hELLO World",)], "s string").select(T.capitalize("s").alias("c")).first()
    assert c["c"] == "Hello world"


def test_answer_tokens(spark):
    r = spark.createDataFrame([("a b|c| d e ",)], "s string").select(T.answer_tokens("s").alias("t")).first()
    assert r["t"] == ["a", "b", "c", "d", "e"]


def test_strip_equals_its_regular_expression(spark):
    texts = ["", " ", " a b ", "\t\na\x0b\f\r", "a \u0085", "a  ", " a  ", "a \n\u0085", "a\u0085 ", "a ", " a", "　 a 　",
             "a\r\n", "  ", "\u0085", "a\x1c", "ä    ", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.strip("s").alias("t"), F.regexp_replace("s", T._WS_EDGES, "").alias("want")).collect()
    assert [r["t"] for r in got] == [r["want"] for r in got] and got[5]["t"] == "a "


def test_joined_words_come_apart_as_they_were(spark):
    df = spark.createDataFrame([("",), ("3",), ("12 0 5",), (None,)], "s string")
    got = df.select(T.split_joined("s").alias("a"), T.split_ws("s").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [[], ["3"], ["12", "0", "5"], None]
