import zlib

import numpy as np
import pandas as pd
from llm_fixtures import SF001, docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import ann, language_id, queries, toxicity
from qaspark.llm.common import fold_is

SF = SF001.replace("sf0.001", "sf0.01")


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    y = np.asarray(y)
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_id"](spark, SF).toPandas()
    truth = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]].merge(got, on="doc_id")
    assert len(truth) == len(got)
    fold = truth.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (truth.held_out == fold).all()
    held = truth[truth.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_language_edges_and_ties(spark, docs_of):
    rows = [(1, "aaa aaa"), (2, "bbb bbb"), (3, None), (4, ""), (5, "123 !?"), (6, "x" * 200_000), (None, "aaa"), (1, "aaa aaa")]
    docs = docs_of(rows).withColumn("lang", F.when(F.col("text").contains("a"), "A").when(F.col("text").contains("b"), "B"))
    profiles = language_id.learn_profiles(docs, size=50)
    assert {r.lang for r in profiles.collect()} == {"A", "B"}
    out = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", F.lit("clash")), profiles, size=50).collect()}
    assert out[1].lang_pred == "A" and out[2].lang_pred == "B" and out[None].lang_pred == "A"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert out[6].lang_pred == "A"  # as far from both: the first by name
    none = language_id.learn_profiles(docs.where(F.lit(False)))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_profile_is_the_most_frequent_ngrams(spark, docs_of):
    docs = docs_of([(1, "ab ab c"), (2, "Ab. b")])
    got = [(r.gram, r["rank"]) for r in language_id.learn_profiles(docs, size=6).orderBy("rank").collect()]
    counts = {}
    for t in ("ab ab c", "Ab. b"):
        s = " " + " ".join(t.lower().replace(".", " ").split()) + " "
        grams = [c for c in s if c != " "] + [s[i:i + 2] for i in range(len(s) - 1)]
        grams += [s[i:i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
        for g in grams:
            k = 0
            for c in g:
                k = k << 21 | ord(c)
            counts[k] = counts.get(k, 0) + 1
    want = sorted(counts, key=lambda k: (-counts[k], k))[:6]
    assert got == [(g, i) for i, g in enumerate(want)]


def test_toxicity_held_out(spark):
    got = queries.QUERIES["op8_toxicity"](spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert auc(held.toxic, held.score) >= 0.9
    assert held[held.toxic == 0].predicted.mean() <= 0.03
    assert held[held.toxic == 1].predicted.mean() >= 0.7


def test_toxicity_neighbours_are_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), learnable=~fold_is("doc_id", 3, 1))
    dense = np.zeros((len(index.ids), len(index.terms)))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for r in docs.limit(150).collect():
        t, w = index.vector(index.space.counts(r.text))
        q = np.zeros(len(index.terms))
        q[t] = w
        cos = np.round(dense @ q, 12)
        order = sorted((i for i in range(len(cos)) if cos[i] > 0), key=lambda i: (-cos[i], index.ids[i]))[:15]
        assert [i for i, _ in index.nearest(t, w, 15)] == order
    assert 0 < index.read[1] < index.read[0]  # some blocks need not be read


def test_toxicity_edges(spark, docs_of):
    rows = [(i, "bad vile words" if i % 3 == 0 else "kind and fair words") for i in range(60)] + [(70, None), (71, ""), (None, "vile"), (3, "bad vile words")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs_of(rows), labels, min_chi2=5.0)
    out = {r.doc_id: r for r in toxicity.score(docs_of(rows), index).collect()}
    assert out[0].score > 0.9 and out[1].score < 0.1 and out[None].score > 0.7
    assert out[70].score == out[71].score < 0.7
    assert out[0].evidence[0].label == 1
    assert toxicity.fit(docs_of(rows), labels.where("toxic = 1")) is None
    assert toxicity.score(docs_of(rows), None).where("score <> 0").count() == 0
    assert toxicity.score(docs_of([]).where(F.lit(False)), index).count() == 0


def test_toxicity_space_is_the_whole_vocabulary(spark, docs_of):
    rng = np.random.RandomState(5)
    plain = lambda n: " ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}q" for a, b, c in rng.randint(0, 8, (n, 3)))
    rows = [(i, f"vile {plain(8)}") for i in range(200)] + [(200 + i, plain(8)) for i in range(400)]
    rows += [(600 + i, f"zorgon blemfar {plain(8)}") for i in range(4)]  # marks of less than 2 % of the toxic rows
    rows += [(620 + i, f"{plain(150)} vile") for i in range(40)]  # long clean texts with one such word
    labels = spark.createDataFrame([(i, int(i < 200 or 600 <= i < 604)) for i, _ in rows], "doc_id long, toxic int")
    new = [(700, f"zorgon blemfar {plain(8)}"), (701, f"vile {plain(8)}"), (702, f"vile {plain(150)}"), (703, plain(8))]
    index = toxicity.fit(docs_of(rows), labels)
    assert set(index.terms) == {w for _, x in rows for w in x.split()}
    out = {r.doc_id: r.score for r in toxicity.score(docs_of(new), index).collect()}
    assert out[700] > 0.7 and out[701] > 0.7 and out[702] < 0.3 and out[703] < 0.3, out


def test_toxicity_examples_are_bounded_by_bytes(spark, docs_of):
    rows = [(i, f"vile w{i}") for i in range(40)] + [(100 + i, f"kind v{i}") for i in range(40)] + [(300, "vile " * 40_000)]
    labels = spark.createDataFrame([(i, int(i < 100 or i == 300)) for i, _ in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs_of(rows), labels, max_bytes=1000)
    assert len(index.ids) == 80 and 300 not in index.ids
    out = {r.doc_id: r for r in toxicity.score(docs_of([(900, "vile"), (901, "kind"), (902, "vile " * 100_000)]), index).collect()}
    assert out[900].score > 0.7 > out[901].score and out[902].score > 0.7


def test_toxicity_learns_from_distinct_texts(spark, docs_of):
    rng = np.random.RandomState(6)
    plain = lambda n: " ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}q" for a, b, c in rng.randint(0, 8, (n, 3)))
    copied = "copied " + plain(60)
    rows = [(i, f"vile {plain(8)}") for i in range(60)] + [(100 + i, f"kind fair gentle {plain(8)}") for i in range(200)]
    rows += [(400 + i, copied) for i in range(300)]
    labels = spark.createDataFrame([(i, int(not 100 <= i < 300)) for i, _ in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs_of(rows), labels, max_examples=40)
    texts = dict(rows)
    assert len({texts[i] for i in index.ids.tolist()}) == len(index.ids) == 80
    assert abs(index.weights[index.labels == 1].sum() - 360) < 1e-9 and abs(index.weights[index.labels == 0].sum() - 200) < 1e-9
    out = {r.doc_id: r.score for r in toxicity.score(docs_of([(800, f"vile {plain(8)}"), (801, f"kind fair gentle {plain(8)}")]), index).collect()}
    assert out[800] > 0.7 and out[801] < 0.3, out


def brute(x, ids, q, k):
    s = (x * x[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_neighbours_recall_and_scores(spark):
    e = pd.read_parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet")
    x, ids = np.array(e.embedding.to_list(), np.float64), e.vec_id.to_numpy()
    got = queries.QUERIES["op7_ann"](spark, SF.replace("0.01", "0.1")).toPandas()
    hits = 0
    queried = np.flatnonzero(ids % 50 == 0)
    for q in queried:
        mine = got[got.query_id == ids[q]].sort_values("rank")
        truth = brute(x, ids, q, 5)
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert mine.score.is_monotonic_decreasing
        known = {v: s for v, s in brute(x, ids, q, len(ids))} if q == queried[0] else dict(truth)
        for v, s in zip(mine.vec_id, mine.score, strict=True):
            assert v not in known or abs(known[v] - s) < 1e-12
        hits += len(set(mine.vec_id) & {v for v, _ in truth})
    assert hits / (5 * len(queried)) >= 0.9


def test_neighbours_edges(spark):
    rng = np.random.RandomState(3)
    rows = [(i, [float(v) for v in rng.randn(8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(100)]  # one vector many times
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0] * 3), (None, [1.0] * 8), (1050, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, leaf string")
    got = ann.search(ann.build(table, leaf_rows=16), F.col("id") % 50 == 0).toPandas()
    assert set(got.query_id) == {0, 50, 100, 150, 200, 250, 1000, 1050}
    assert not set(got.vec_id) & {2000, 2001, 2002, 2003, 2004, 2005}
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == [1001, 1002, 1003, 1004, 1005]
    twice = table.unionByName(spark.createDataFrame([(100, [9.0] + [-9.0] * 7, 0, "x")], table.schema))
    small = min([float(x) for x in np.float32(rows[100][1])], [9.0] + [-9.0] * 7)
    first = {r.vec_id: r.score for r in ann.search(ann.build(twice, leaf_rows=16), F.col("id") == 100).collect()}
    x = np.array([np.float32(v) for i, v in rows[:300] if i != 100], np.float64)
    best = (x @ np.array(small) / np.sqrt((x * x).sum(axis=1)) / np.linalg.norm(small)).max()
    assert abs(max(first.values()) - max(best, max(s for v, s in first.items() if v >= 1000) if any(v >= 1000 for v in first) else best)) < 1e-9
    few = table.where("vec_id in (0, 1, 2)")
    assert ann.search(ann.build(few), F.col("id") == 0).count() == 2
    assert ann.build(table.where(F.lit(False))) is None


def test_queries_of_a_leaf_are_split(spark):
    rows = spark.range(3000).selectExpr("id", "array(1D, 2D) AS v", "CAST(IF(id < 2500, 0, 1) AS INT) AS leaf")
    asked, held = ann.in_blocks(rows.where("id % 2 = 0"), rows, np.array([10, 2, 1]), bound=100)
    keys = ["leaf", "qb", "block"]
    assert asked.groupBy(keys).count().agg({"count": "max"}).first()[0] < 150
    assert held.groupBy(keys).count().agg({"count": "max"}).first()[0] < 375
    pairs = asked.selectExpr("id AS q", *keys).join(held.selectExpr("id AS x", *keys), keys).select("q", "x")
    assert pairs.count() == pairs.distinct().count() == 1250 * 2500 + 250 * 500
