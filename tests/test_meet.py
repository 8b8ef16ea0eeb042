import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.operators import features as FT
from qaspark.operators import generate as G
from qaspark.operators import holographic as H
from qaspark.operators import vectors as VEC
from qaspark.operators import vocab as VO
from qaspark.operators import word_vectors as WV
from qaspark.plans import q_models


def _table(rng):
    return {f"w{i}": rng.normal(size=3).tolist() for i in range(40)} | {"z": [0.0] * 3}


def test_large_vector_tables_do_not_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    of = _table(rng)
    vectors = spark.createDataFrame(list(of.items()), "token string, vec array<double>")
    rows = [(i, [str(w) for w in rng.choice([*of, "oov"], size=rng.integers(0, 7))]) for i in range(80)] + [(99, None)]
    s = spark.createDataFrame(rows, "id int, tokens array<string>")
    monkeypatch.setattr(VEC, "PART_BYTES", 1)  # many parts
    monkeypatch.setattr(type(vectors), "toArrow", lambda self: pytest.fail("vectors gathered on the driver"))
    got = {r["id"]: r["vec"] for r in VEC.sentence_vectors(s, ["id"], "tokens", vectors, [1.0, 2.0, 0.0], block_bytes=100).collect()}
    for i, words in rows:
        v = [x for x in (np.array(of.get(w, [1.0, 2.0, 0.0])) for w in words or []) if x.any()]
        assert got[i] == pytest.approx(np.mean(v, axis=0).tolist() if v else [0.0] * 3)


def test_folds_of_ids_alone_shared_and_missing(spark):
    rng = np.random.default_rng(10)
    of = _table(rng)
    vectors = spark.createDataFrame(list(of.items()), "token string, vec array<double>")
    s = spark.createDataFrame([(1, ["w1", "z", "w2", "no"]), (2, []), (3, ["w3"]), (3, ["w3"]), (None, ["w4"])], "id int, tokens array<string>")
    got = sorted((r["id"] or 0, r["vec"]) for r in H.sentence_holographic(s, ["id"], "tokens", vectors, [0.5] * 3).collect())
    twice = H.fold_all([[of["w3"], of["w3"]]], 3)[0]
    want = [(0, [0.0] * 3), (1, H.fold_all([[of["w1"], of["w2"], [0.5] * 3]], 3)[0]), (2, [0.0] * 3), (3, twice), (3, twice)]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(a == pytest.approx(list(b), abs=1e-12) for (_, a), (_, b) in zip(got, want))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_indices_by_lookup_and_by_join_agree(spark, monkeypatch, limit):
    rows = spark.createDataFrame([(1, ["a", "b", None], []), (2, None, ["a"]), (3, ["c"], ["x"]), (3, ["c"], ["x"]), (None, ["a"], ["a"])],
                                 "row_id int, q array<string>, a array<string>")
    vocab = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("a", "a", 7)], "side string, token string, idx long")
    monkeypatch.setattr(VO, "LOOKUP_BYTES", limit)
    assert (VO.lookup_indices(rows, {"q": "q", "a": "a"}, vocab) is None) == (limit == 0)
    got = sorted(((r["row_id"] or 0), r["q"], r["a"]) for r in FT.as_indices(rows, {"q": "q", "a": "a"}, vocab).collect())
    assert got == [(0, [], []), (1, [1, 0, 0], []), (2, [], [7]), (3, [2, 2], [0, 0]), (3, [2, 2], [0, 0])]


def test_each_distinct_text_is_normalised_once(spark):
    lines = spark.createDataFrame([(i, "Who is May 3\te1|r one|e2") for i in range(5)] + [(9, "no tab"), (10, None)], "line_no int, value string")
    rows = G.read_train(lines, mode="proc_token")
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
    plain = lines.where("line_no < 5")
    f = G._fields(plain, 2).select("row_id", G.represent(F.col("f0"), "proc_token").alias("q"), G.represent(F.col("f1"), "proc_token", True).alias("a"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, f.collect())) and rows.count() == 5


def test_word2vec_holds_no_model_on_the_driver(spark, monkeypatch):
    s = spark.createDataFrame([(["a", "b", "c"],), (["a", "c"],)], "tokens array<string>")
    monkeypatch.setattr(q_models, "training_sentences", lambda spark, d: s)
    seen = []
    train = WV.train
    monkeypatch.setattr(WV, "train", lambda *a, **k: seen.append(k) or train(*a, **k))
    got = {r["token"]: r["vec"] for r in q_models.word2vec_train(spark, "", size=6).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 6 for v in got.values()) and seen[0]["epochs"] == 1


def test_folds_that_overflow_are_null(spark):
    assert H._fold_lists(np.array([[np.nan, 1.0], [2.0, 3.0]])).to_pylist() == [[None, 1.0], [2.0, 3.0]]
    vectors = spark.createDataFrame([("big", [1e200, -1e200]), ("one", [1.0, 0.0])], "token string, vec array<double>")
    s = spark.createDataFrame([(1, ["big", "big", "big", "big"]), (2, ["one"])], "id int, tokens array<string>")
    nodes = s.selectExpr("id", "posexplode(tokens) AS (ord, token)").selectExpr(
        "id", "concat('n', ord) AS node", "cast(null AS string) AS parent", "ord", "token")
    got = {r["id"]: r["vec"] for r in H.fold_tree(s, nodes, ["id"], vectors, [0.0, 0.0]).collect()}
    assert got[2] == [1.0, 0.0] and all(x is None or x == x for x in got[1])


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("grams", [1, 2, 3])
def test_training_lines_take_the_indices_of_their_distinct_texts(spark, monkeypatch, shared, grams):
    """Every distinct text is normalised and indexed once, for the vocabulary and the lines; lines that share a number are put together."""
    from qaspark.plans import q_io
    from qaspark.plans.q_vocab import train_vocab

    rows = [(i, f"Who is May {i % 3}\te{i % 2}|r one|e2") for i in range(9)] + [(20, "\tx"), (21, "q\t"), (22, "no tab"), (23, None), (24, " A\tB  ")]
    rows += [(1, "What is it\te1|r|e2"), (None, "Who is here\te1"), (None, "Who\te1")] if shared else []
    lines = spark.createDataFrame(rows, "line_no long, value string")
    monkeypatch.setattr(q_io.X, "train_lines", lambda *_: lines)
    seen = []
    own = FT.as_indices
    monkeypatch.setattr(FT, "as_indices", lambda t, *a, **k: seen.append(t.count()) or own(t, *a, **k))
    got = sorted((r["row_id"] or 0, r["q"], r["a"]) for r in q_io._train_indices(spark, "x", grams).collect())
    texts = [v.strip().split("\t") for _, v in rows if v is not None]
    assert seen == [len({t[i] for t in texts if len(t) == 2}) for i in (0, 1)]
    plain = FT.as_indices(G.read_train(lines, mode="proc_token", grams=grams), {"q": "q", "a": "a"}, train_vocab(spark, "x", grams)) \
        .select("row_id", FT.sentence_text("q", "index").alias("q"), FT.sentence_text("a", "index").alias("a"))
    assert got == sorted((r["row_id"] or 0, r["q"], r["a"]) for r in plain.collect()) and any(q for _, q, _ in got)
