import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qaspark.functions import vector as V
from qaspark.operators import holographic as H
from qaspark.operators import vectors as VEC


def test_sentence_mean_rules(spark):
    vecs = spark.createDataFrame([("z", [0.0, 0.0]), ("x", [2.0, 0.0]), ("y", [0.0, 4.0])], "token string, vec array<double>")
    s = spark.createDataFrame([(1, ["z", "x", "y"]), (2, ["z"]), (3, ["oov", "x"]), (4, [])],
                              "id int, tokens array<string>")
    out = {r["id"]: r["vec"] for r in VEC.sentence_vectors(s, ["id"], "tokens", vecs, [10.0, 10.0]).collect()}
    assert out[1] == pytest.approx([1.0, 2.0])
    assert out[2] == [0.0, 0.0]
    assert out[3] == pytest.approx([6.0, 5.0])
    assert out[4] == [0.0, 0.0]


def test_cosine_zero_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "u array<double>, v array<double>")
    r = df.select(V.cosine_distance("u", "v").alias("d")).collect()
    assert r[0]["d"] is None and r[1]["d"] == pytest.approx(0.0)


def test_circular_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([0.0, 0.0, 0.0], [4.0, 5.0, 6.0])],
                               "a array<double>, b array<double>")
    r = df.select(V.circular_correlation("a", "b", 3).alias("c")).collect()
    assert r[0]["c"] == pytest.approx([32.0, 29.0, 29.0])
    assert r[1]["c"] == [4.0, 5.0, 6.0]
    assert H.cc_fft(np.array([1.0, 2, 3]), np.array([4.0, 5, 6])) == pytest.approx([32, 29, 29])


def test_fold_native_equals_fft(spark):
    rng = np.random.default_rng(0)
    vs = [rng.normal(size=5).tolist() for _ in range(4)] + [[0.0] * 5]
    df = spark.createDataFrame([(vs,)], "vecs array<array<double>>")
    native = df.select(V.fold_correlation("vecs", 5).alias("f")).first()["f"]
    assert native == pytest.approx(H.fold_all([vs], 5)[0].tolist(), abs=1e-9)


def test_answer_structure_native_equals_fft(spark):
    rng = np.random.default_rng(5)
    e1, r, e2 = ([rng.normal(size=4).tolist() for _ in range(n)] for n in (2, 3, 1))
    df = spark.createDataFrame([(e1, r, e2)], "e1 array<array<double>>, r array<array<double>>, e2 array<array<double>>")
    native = df.select(H.answer_structure("e1", "r", "e2", 4).alias("h")).first()["h"]
    fft = df.select(H.structure_udf(4)("e1", "r", "e2").alias("h")).first()["h"]
    assert native == pytest.approx(fft, abs=1e-9)


def test_folds_of_many_lists_at_once(spark):
    rng = np.random.default_rng(7)
    lists = [[rng.normal(size=6) for _ in range(n)] for n in (3, 0, 1, 5, 2)] + [[np.zeros(6)], [np.zeros(6), np.ones(6)], None]
    got = H.fold_all(lists, 6)
    for vecs, row in zip(lists, got, strict=True):
        acc = np.zeros(6)
        for v in vecs or []:
            acc = H.cc_fft(acc, v)
        assert row == pytest.approx(acc, abs=1e-9)


def test_answers_of_several_words(spark):
    rng = np.random.default_rng(8)
    table = [(f"w{i}", rng.normal(size=4).tolist()) for i in range(6)]
    vectors = spark.createDataFrame(table, "token string, vec array<double>")
    answers = spark.createDataFrame([(1, ["w0", "w1"], ["w2"], ["w3", "w4", "new"]), (2, ["w5"], [], ["w1"])],
                                    "id int, e1 array<string>, r array<string>, e2 array<string>")
    out = {x["id"]: x["vec"] for x in H.answer_holographic(
        answers, ["id"], {"e1": "e1", "r": "r", "e2": "e2"}, vectors, [0.5] * 4).collect()}
    of = dict(table) | {"new": [0.5] * 4}
    for i, parts in ((1, (["w0", "w1"], ["w2"], ["w3", "w4", "new"])), (2, (["w5"], [], ["w1"]))):
        e1, r, e2 = (H.fold_all([[of[w] for w in p]], 4)[0] for p in parts)
        assert out[i] == pytest.approx(H.cc_fft(r, H.cc_fft(e1, e2)).tolist(), abs=1e-9)


def test_lookup_in_blocks_and_by_join_agree(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["é", "z"]
    vecs = [(w, [0.0, 0.0, 0.0] if w == "z" else rng.normal(size=3).tolist()) for w in words]
    table = spark.createDataFrame(vecs, "token string, vec array<double>")
    rows = [(i, [str(w) for w in rng.choice([*words, "oov", ""], size=rng.integers(0, 9))]) for i in range(200)] + [(900, []), (901, None), (902, ["z"])]
    s = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    known, unknown = dict(vecs), [0.5, 0.0, -1.0]
    want = {}
    for i, ws in rows:
        v = [np.array(known.get(w, unknown)) for w in ws or []]
        v = [x for x in v if x.any()]
        want[i] = (sum(v) / len(v)).tolist() if v else [0.0] * 3
    for size in (1 << 20, 1500, 100):  # one block, several, the join
        got = {r["id"]: r["vec"] for r in VEC.sentence_vectors(s, ["id"], "tokens", table, unknown, block_bytes=size).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want), size


def test_nested_fold(spark):
    rng = np.random.default_rng(4)
    vecs = {w: rng.normal(size=4).tolist() for w in "abcde"} | {"z": [0.0] * 4}
    table = spark.createDataFrame(list(vecs.items()), "token string, vec array<double>")
    unknown = rng.normal(size=4).tolist()
    trees = {1: ["a", ["b", ["c", ["d", "e"]], "a"], "z"], 2: [["a", "b"], [], ["oov"]], 3: [], 4: ["a"], 5: [[["b"]]]}
    rows = []

    def put(i, items, parent):
        for k, x in enumerate(items):
            node = f"{parent or ''}.{k}"
            rows.append((i, node, parent, k, None if isinstance(x, list) else x))
            if isinstance(x, list):
                put(i, x, node)

    def fold(items):
        out = np.zeros(4)
        for x in items:
            out = H.cc_fft(out, fold(x) if isinstance(x, list) else np.array(vecs.get(x, unknown)))
        return out

    for i, t in trees.items():
        put(i, t, None)
    rows.append((4, "lost", "nowhere", 0, "b"))  # below no list of the sentence
    nodes = spark.createDataFrame(rows, "id int, node string, parent string, ord int, token string")
    sents = spark.createDataFrame([(i,) for i in trees], "id int")
    got = {r["id"]: r["vec"] for r in H.fold_tree(sents, nodes, ["id"], table, unknown).collect()}
    for i, t in trees.items():
        assert got[i] == pytest.approx(fold(t).tolist(), abs=1e-9), i
    empty = H.fold_tree(sents, nodes.where("id > 90"), ["id"], table, unknown).collect()
    assert all(r["vec"] == [0.0] * 4 for r in empty)


EDGE_LINES = ["'abc' d'ef", "a.b 'c'", "' ' x '", "\t'y\t'", "don't @ 5-6 a@b", "x '\u2028", "u \u2028", "v\u0085 w ", "  plain, words. ",
              "ΌΣΟΣ ΑΣ", "İx ÇA", "", None, "a\r\nb 'c\rd\n\n'e'", "\u00a0z\u00a0 z", "q''r", "---", "a\x0bb\x0cc", "it's 'it's'", "m '\u2029n'"]


def test_corpus_counts_from_words_equal_those_from_lines(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*EDGE_LINES, "\n".join(t for t in EDGE_LINES if t)])], "doc_id long, text string")
    words = VEC.corpus_words(docs)
    got = {r["token"]: r["count"] for r in VEC.corpus_counts_of_words(words, docs).collect()}
    assert got == {r["token"]: r["count"] for r in VEC.corpus_counts(VEC.corpus_lines(docs)).collect()}
    lowered = {r[0]: r[1] for r in words.groupBy(F.lower("word")).agg(F.sum("count")).collect()}
    plain = docs.select(F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("t")).groupBy("t").count()
    assert lowered == {r["t"]: r["count"] for r in plain.collect()}


def test_symbol_cleaner_equals_its_rules_one_by_one(spark):
    from qaspark.functions import text as T
    rules = [(r"(\')", " $1"), (r"(\.|\?|\$|\#|\&|\,|\!|\;|\`|\~|\"|\\|\:|\+|\-|\*|\/)", " "), (r"\@", " at "), (r" +", " "),
             (r"^[\' ]+", ""), (r"[\' ]+$", "")]
    rng = np.random.default_rng(1)
    alphabet = list(" '.?$#&,!;`~\"\\:+-*/@ab\t\n\r\u0085\u2028^[]")
    texts = [t for t in EDGE_LINES if t] + ["".join(rng.choice(alphabet, size=rng.integers(1, 14))) for _ in range(3000)]
    one = F.col("s")
    for pattern, to in rules:
        one = F.regexp_replace(one, pattern, to)
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.no_symbol("s").alias("got"), T.strip(one).alias("want"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_sums_in_blocks_equal_sums_at_once(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    lookup = VEC.Lookup([str(i) for i in range(20)], np.vstack([np.zeros(3), rng.normal(size=(19, 3))]), [0.5, 0.0, 1.0])
    tokens = pa.array([[str(x) for x in rng.integers(0, 22, k)] for k in rng.integers(0, 40, 60)] + [None, [], ["0"]])
    want = lookup.sums(tokens)
    for rows in (1, 7, 64):
        monkeypatch.setattr(VEC, "SUM_ROWS", rows)
        got = lookup.sums(tokens)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_a_large_table_in_few_files_is_dealt_by_its_bytes():
    from qaspark.sources.tables import spread_tasks
    assert spread_tasks(1 << 30, 12) == 128 and spread_tasks(16 << 20, 12) == 12 and spread_tasks(1 << 19, 12) == 4


def test_vectors_travel_in_32_bits_only_where_they_hold_them(spark):
    rows = [("a", [1.5, -0.0, 0.1]), ("b", [1.5, -0.0, float(np.float32(0.1))]), ("c", [float("nan"), 2.0, 3.0]), ("d", [1e300, 0.0, 1.0]),
            ("e", None), ("f", [None, 1.0, 2.0])]
    got = spark.createDataFrame(rows, "token string, vec array<double>").select("token", *VEC.packed("vec"))
    kept = {r["token"]: (r["_f4"], r["_f8"]) for r in got.collect()}
    assert {t for t, (f4, _) in kept.items() if f4 is not None} == {"b", "c"} and all(f4 is None or f8 is None for f4, f8 in kept.values())
    assert kept["a"][1] == [1.5, -0.0, 0.1] and kept["d"][1] == [1e300, 0.0, 1.0] and kept["e"] == (None, None)
    for tokens in (["a", "b", "d"], ["b", "b"], ["a", "d"]):
        f4 = pa.array([kept[t][0] for t in tokens], pa.list_(pa.float32()))
        f8 = pa.array([kept[t][1] for t in tokens], pa.list_(pa.float64()))
        assert VEC.unpacked(f4, f8, 3).tolist() == [x for t in tokens for x in dict(rows)[t]]


def test_sentences_meet_vectors_of_32_and_64_bits(spark):
    vectors = spark.createDataFrame([("a", [0.1, 2.0]), ("b", [0.5, 4.0]), ("c", [float(np.float32(0.3)), 1.0])], "token string, vec array<double>")
    s = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "x"]), (3, [])], "id long, tokens array<string>")
    near, met = ({r["id"]: r["vec"] for r in VEC.sentence_vectors(s, ["id"], "tokens", vectors, [0.7, 0.7], block_bytes=n).collect()} for n in (1 << 20, 0))
    assert near == met and met[1] == [(0.1 + 0.5) / 2, 3.0]


def test_nested_folds_broadcast_no_table_by_the_size_of_its_file(spark, monkeypatch):
    """Levels of a tree and word vectors shrink on disk; a broadcast of what their files seem to hold would go through the driver."""
    plans = []
    for module in (H, VEC):
        own = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, own=own: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    ids = ["id"]
    n = 400
    vectors = VEC.materialize(spark.range(9).selectExpr("concat('w', id) AS token", "array(cast(id AS double) + 1, 2D) AS vec"), "vectors")
    s = spark.range(n)
    items = [(None, "a", None, 0), ("a", "b", None, 1), ("a", "w1", "w1", 0), ("b", "w2", "w2", 1), ("b", "w3", "w3", 2)]
    nodes = VEC.materialize(s.crossJoin(spark.createDataFrame(items, "parent string, node string, token string, ord int")), "nodes")
    plans.clear()
    got = H.fold_tree(s, nodes, ids, vectors, [0.0, 0.0])
    rows = got.collect()
    assert len(rows) == n and all(r["vec"] == pytest.approx(rows[0]["vec"]) for r in rows) and any(rows[0]["vec"])
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
