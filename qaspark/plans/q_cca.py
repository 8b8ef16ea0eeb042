"""Gram sums, projections and CCA model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from qaspark.operators import cca as CCA
from qaspark.operators import features as FT
from qaspark.operators import sparse_cca as SC
from qaspark.operators import vocab as VO
from qaspark.operators import wide_cca as WC
from qaspark.plans import duck as D
from qaspark.plans import pipelines as P
from qaspark.plans.catalog import query
from qaspark.plans.q_io import duck_pair_counts
from qaspark.plans.q_vectors import _DUCK_SENT, pair_vectors, unknown_for
from qaspark.sources import fixtures as X
from qaspark.functions import text as T
from qaspark.operators import vectors as VEC
from qaspark.session import materialize


def qa_features(spark, d, vectors=None, unknown=None):
    """``(conv_id, turn, qv, av)``: mean-vector features of the QA pairs."""
    return VEC.pivot_sides(pair_vectors(spark, d, vectors, unknown), ["conv_id", "turn"], {"qv": "q", "av": "a"})


def paraphrase_features(spark, d, vectors=None, unknown=None):
    vectors = vectors if vectors is not None else X.word_vectors(spark, d)
    unknown = unknown if unknown is not None else unknown_for(spark, d, vectors)
    p = X.paraphrase_pairs(spark, d)
    p = p.select("conv_id", "turn", T.split_ws(T.no_symbol("q1")).alias("t1"), T.split_ws(T.no_symbol("q2")).alias("t2"))
    sents = VEC.long_sides(p, ["conv_id", "turn"], {1: "t1", 2: "t2"})
    sv = VEC.sentence_vectors(sents, ["conv_id", "turn", "side"], "tokens", vectors, unknown)
    return VEC.pivot_sides(sv, ["conv_id", "turn"], {"qv": 1, "av": 2})


_DUCK_GRAM = _DUCK_SENT


@query("gram_qa", D.with_fx("""
SELECT CAST(q.i - 1 AS INTEGER) AS i, CAST(a.i - 1 AS INTEGER) AS j, round(sum(q.x * a.x), 6) + 0.0 AS v
FROM sv q JOIN sv a ON a.conv_id = q.conv_id AND a.turn = q.turn AND a.side = 'a'
WHERE q.side = 'q' GROUP BY q.i, a.i""", "fx_word_vectors", "fx_pairs", extra=_DUCK_GRAM))
def gram_qa(spark, d):
    g = CCA.gram_table(qa_features(spark, d), "qv", "av")
    return (g.filter(F.col("kind") == "qa").select("i", F.posexplode("row").alias("j", "v"))
            .select("i", F.col("j").cast("int").alias("j"), (F.round("v", 6) + 0.0).alias("v")))


@query("gram_diag", D.with_fx("""
SELECT side, CAST(i - 1 AS INTEGER) AS i, round(sum(x * x), 6) + 0.0 AS v FROM sv GROUP BY side, i""",
                              "fx_word_vectors", "fx_pairs", extra=_DUCK_GRAM))
def gram_diag(spark, d):
    g = CCA.gram_table(qa_features(spark, d), "qv", "av")
    g = g.filter(F.col("kind").isin("qq", "aa"))
    return g.select(F.substring("kind", 1, 1).alias("side"), F.posexplode("row").alias("i", "v")).select(
        "side", F.col("i").cast("int").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


def fixed_blocks(spark, d, width):
    """Two ``width x width`` matrices taken from the embedding table rows."""
    rows = (X._vectors(spark, d).filter(F.col("vec_id") < 2 * width)
            .select("vec_id", "vec").collect())  # bounded: 2 * width rows
    m = np.zeros((2 * width, width))
    for r in rows:
        m[r["vec_id"]] = np.asarray(r["vec"][:width])
    return m[:width], m[width:]


@query("project_concat", D.with_fx("""
SELECT q.conv_id, q.turn, CAST((m.vec_id // w.d) * w.d + m.j - 1 AS BIGINT) AS dim, round(sum(q.x * m.m), 6) + 0.0 AS value
FROM sv q, w, (SELECT vec_id, unnest(vec) AS m, generate_subscripts(vec, 1) AS j FROM fx_emb) m
WHERE q.side = 'q' AND m.vec_id < 2 * w.d AND m.vec_id % w.d = q.i - 1
GROUP BY q.conv_id, q.turn, m.vec_id // w.d, m.j, w.d""", "fx_word_vectors", "fx_pairs", "fx_emb",
                                    extra=_DUCK_GRAM + [("w", "SELECT max(len(vec)) AS d FROM fx_word_vectors")]))
def project_concat(spark, d):
    f = qa_features(spark, d)
    width = VEC.width(X.word_vectors(spark, d))
    m1, m2 = fixed_blocks(spark, d, width)
    p = CCA.project(f.select("conv_id", "turn", "qv"), "qv", [m1, m2], "pv")
    return p.select("conv_id", "turn", F.posexplode("pv").alias("dim", "value")).select(
        "conv_id", "turn", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


def one_stage(spark, d, k=None):
    return CCA.fit(qa_features(spark, d), "qv", "av", k)


def paraphrase_map(spark, d, k=None):
    return CCA.fit(paraphrase_features(spark, d), "qv", "av", k)


def two_stage(spark, d, k=None):
    para = paraphrase_map(spark, d)
    return CCA.fit_two_stage(qa_features(spark, d), "qv", "av", para, k), para


@query("cca_one_stage")
def cca_one_stage(spark, d):
    return one_stage(spark, d).to_df(spark)


@query("cca_paraphrase_map")
def cca_paraphrase_map(spark, d):
    return paraphrase_map(spark, d).to_df(spark)


@query("cca_two_stage")
def cca_two_stage(spark, d):
    return two_stage(spark, d)[0].to_df(spark)


@query("cca_scores")
def cca_scores(spark, d):
    """Distances of every QA pair under the 0-, 1- and 2-stage models. The features of the pairs and of the
    paraphrases are written once; models and distances read them."""
    vectors = X.word_vectors(spark, d)
    unknown = unknown_for(spark, d, vectors)
    f = materialize(qa_features(spark, d, vectors, unknown), "qa-features")
    para = CCA.fit(materialize(paraphrase_features(spark, d, vectors, unknown), "paraphrase-features"), "qv", "av")
    m1 = CCA.fit(f, "qv", "av")
    m2 = CCA.fit_two_stage(f, "qv", "av", para)
    s0 = CCA.score(f, "qv", "av").select("conv_id", "turn", F.lit(0).alias("stage"), "dist")
    s1 = CCA.score(f, "qv", "av", m1).select("conv_id", "turn", F.lit(1).alias("stage"), "dist")
    s2 = CCA.score(f, "qv", "av", m2, para).select("conv_id", "turn", F.lit(2).alias("stage"), "dist")
    return s0.unionByName(s1).unionByName(s2).withColumn("dist", F.round("dist", 6))


@query("sparse_cca")
def sparse_cca(spark, d, k: int = 10):
    """CCA over unigram count features (randomized truncated SVD, no Gram matrix)."""
    return SC.fit_sparse(P.featurize(spark, d, "unigram"), k=k)


def paraphrase_counts(spark, d, kind="unigram"):
    """Sparse counts of both sides of the paraphrases over the question vocabulary
    of the pairs, ``(row_id, side, idx, cnt)``."""
    vocab = P.pair_vocab(spark, d, kind).where(F.col("side") == "q")
    both = vocab.unionByName(vocab.withColumn("side", F.lit("a")))
    rows = X.paraphrase_pairs(spark, d).select(
        X.line_key(F.col("conv_id"), F.col("turn")).alias("row_id"),
        T.split_ws(T.tokenize("q1")).alias("q"), T.split_ws(T.tokenize("q2")).alias("a"))
    n = FT.NGRAM_KINDS[kind]
    if n > 1:
        rows = rows.withColumns({"q": T.ngrams(F.col("q"), n), "a": T.ngrams(F.col("a"), n)})
    return VO.ngram_counts(VO.index_tokens(VO.side_tokens(rows, {"q": "q", "a": "a"}), both))


@query("sparse_cca_two_stage")
def sparse_cca_two_stage(spark, d, k: int = 10):
    """Two-stage CCA over bigram counts: paraphrase model, then questions mapped by it with
    the answers; ``(side, idx, k, w)`` over question and answer indices."""
    para, _ = SC.sparse_factors(paraphrase_counts(spark, d, "bigram"), k)
    model = SC.two_stage_model(P.featurize(spark, d, "bigram"), SC.question_map(para), k)
    return model.select("side", "idx", F.posexplode("w").alias("k", "w"))


def given_factors(spark, d, sides, width=4):
    """A model table from the embedding table: index i of a side takes the first
    numbers of vector i (the last ones on side a) modulo the number of vectors."""
    e = X._vectors(spark, d)
    n = e.select(F.count(F.lit(1))).scalar()
    vocab = P.pair_vocab(spark, d, "unigram")
    out = None
    for side, of, at in sides:
        rows = vocab.where(F.col("side") == of).select("idx", (F.col("idx") % n).alias("vec_id")).join(e, "vec_id")
        rows = rows.select(F.lit(side).alias("side"), "idx", F.slice("vec", at, width).alias("w"))
        out = rows if out is None else out.unionByName(rows)
    return out


_DUCK_GIVEN = [("nv", "SELECT count(*) AS n FROM fx_emb")]


@query("sparse_two_stage_product", D.with_fx("""
SELECT z.j, a.idx, round(any_value(n.n) * sum(z.z * a.cnt) / nullif(any_value(dz.d) * any_value(da.d), 0), 6) + 0.0 AS v
FROM z JOIN unigram a ON a.row_id = z.row_id AND a.side = 'a' JOIN dz ON dz.j = z.j JOIN da ON da.idx = a.idx, n
GROUP BY z.j, a.idx""", "fx_pairs", "fx_emb", extra=duck_pair_counts(1, "unigram") + _DUCK_GIVEN + [
    ("pf", "SELECT vec_id, unnest(vec[1:8]) AS x, generate_subscripts(vec[1:8], 1) - 1 AS j FROM fx_emb"),
    ("z", """SELECT u.row_id, pf.j, sum(u.cnt * pf.x) AS z FROM unigram u, nv, pf
             WHERE u.side = 'q' AND pf.vec_id = u.idx % nv.n GROUP BY u.row_id, pf.j"""),
    ("dz", "SELECT j, sum(z * z) AS d FROM z GROUP BY j"),
    ("da", "SELECT idx, sum(cnt * cnt) AS d FROM unigram WHERE side = 'a' GROUP BY idx"),
    ("n", "SELECT count(DISTINCT row_id) AS n FROM unigram")]))
def sparse_two_stage_product(spark, d):
    """The second stage over given question factors, multiplied out: free of signs and
    rotations. ``n^6 * sum_k q_jk s_k a_ik``, where the pair has rows in common."""
    features = P.featurize(spark, d, "unigram")
    mapped = SC.question_map(given_factors(spark, d, [("q", "q", 1), ("a", "q", 5)]))
    answers, q, s = SC.two_stage_factors(features, mapped)
    n = features.select("row_id").distinct().count()
    scaled = (q * s) * float(n) ** 6
    out = SC._apply(answers, scaled.T).select("idx", F.posexplode("w").alias("j", "v"))
    # Pairs of a component and an index that share a row: all components of an answer index.
    return out.select(F.col("j").cast("long").alias("j"), "idx", (F.round("v", 6) + 0.0).alias("v"))


@query("sparse_scores", D.with_fx("""
SELECT r.row_id, round(1 - q.dot / nullif(sqrt(q.qq) * sqrt(q.aa), 0), 6) AS dist
FROM (SELECT DISTINCT row_id FROM unigram) r LEFT JOIN (
  SELECT q.row_id, sum(q.v * a.v) AS dot, sum(q.v * q.v) AS qq, sum(a.v * a.v) AS aa
  FROM pv q JOIN pv a ON a.row_id = q.row_id AND a.j = q.j AND a.side = 'a' WHERE q.side = 'q' GROUP BY q.row_id) q
ON q.row_id = r.row_id""", "fx_pairs", "fx_emb", extra=duck_pair_counts(1, "unigram") + _DUCK_GIVEN + [
    ("pf", """SELECT 'q' AS side, vec_id, unnest(vec[1:4]) AS x, generate_subscripts(vec[1:4], 1) AS j FROM fx_emb
              UNION ALL SELECT 'a', vec_id, unnest(vec[5:8]), generate_subscripts(vec[5:8], 1) FROM fx_emb"""),
    ("pv", """SELECT u.row_id, u.side, pf.j, sum(u.cnt * pf.x) AS v FROM unigram u, nv, pf
              WHERE pf.side = u.side AND pf.vec_id = u.idx % nv.n GROUP BY u.row_id, u.side, pf.j""")]))
def sparse_scores(spark, d):
    """Distances of the pairs under a given model table over sparse counts."""
    model = given_factors(spark, d, [("q", "q", 1), ("a", "a", 5)])
    return SC.score(P.featurize(spark, d, "unigram"), model).select("row_id", F.round("dist", 6).alias("dist"))


@query("sparse_cca_scores")
def sparse_cca_scores(spark, d, k: int = 10):
    """Distances of every pair under the 0-, 1- and 2-stage models over unigram counts."""
    features = P.featurize(spark, d, "unigram")
    para, _ = SC.sparse_factors(paraphrase_counts(spark, d), k)
    one, _ = SC.sparse_factors(features, k)
    models = (None, one, SC.two_stage_model(features, SC.question_map(para), k))
    out = None
    for stage, model in enumerate(models):
        r = SC.score(features, model).select("row_id", F.lit(stage).alias("stage"), F.round("dist", 6).alias("dist"))
        out = r if out is None else out.unionByName(r)
    return out


def _product(features, model):
    """``n^6 * sum_k q_ik s_k a_jk``. With all singular vectors this is
    ``n * C_ij / (dq_i da_j)`` for the sums C, dq, da of products and squares."""
    spark = features.sparkSession
    n = features.count()
    rows = ((model.q * model.s) @ model.a.T) * float(n) ** 6
    out = spark.createDataFrame(list(enumerate(rows.tolist())), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    return out.select("i", F.col("j").cast("int").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


_PRODUCT = """
SELECT CAST(q.i - 1 AS INTEGER) AS i, CAST(a.i - 1 AS INTEGER) AS j,
       round(coalesce(any_value(n.n) * sum(q.x * a.x) / nullif(any_value(dq.d) * any_value(da.d), 0), 0.0), 6) + 0.0 AS v
FROM sv q JOIN sv a ON a.conv_id = q.conv_id AND a.turn = q.turn AND a.side = {a}
JOIN dg dq ON dq.side = {q} AND dq.i = q.i JOIN dg da ON da.side = {a} AND da.i = a.i, n
WHERE q.side = {q} GROUP BY q.i, a.i"""
_DIAGONAL = [("dg", "SELECT side, i, sum(x * x) AS d FROM sv GROUP BY side, i")]


@query("cca_one_stage_product", D.with_fx(_PRODUCT.format(q="'q'", a="'a'"), "fx_word_vectors", "fx_pairs",
                                          extra=_DUCK_GRAM + _DIAGONAL + [("n", "SELECT count(*) AS n FROM fx_pairs")]))
def cca_one_stage_product(spark, d):
    """The one-stage model multiplied out: free of signs and rotations."""
    return _product(qa_features(spark, d), one_stage(spark, d))


_DUCK_PARA = [(n, f"""SELECT conv_id, turn, '1' AS side, {D.split_ws(D.no_symbol('q1'))} AS toks FROM fx_paraphrases
                      UNION ALL SELECT conv_id, turn, '2', {D.split_ws(D.no_symbol('q2'))} FROM fx_paraphrases""") if n == "sent" else (n, b)
              for n, b in _DUCK_GRAM]


@query("cca_paraphrase_product", D.with_fx(_PRODUCT.format(q="'1'", a="'2'"), "fx_word_vectors", "fx_paraphrases",
                                           extra=_DUCK_PARA + _DIAGONAL + [("n", "SELECT count(*) AS n FROM fx_paraphrases")]))
def cca_paraphrase_product(spark, d):
    return _product(paraphrase_features(spark, d), paraphrase_map(spark, d))


@query("cca_wide_product", D.with_fx(_PRODUCT.format(q="'q'", a="'a'"), "fx_word_vectors", "fx_pairs",
                                     extra=_DUCK_GRAM + _DIAGONAL + [("n", "SELECT count(*) AS n FROM fx_pairs")]))
def cca_wide_product(spark, d, block: int = 16):
    """The one-stage model of tiled sums and subspace iteration, multiplied out like
    ``cca_one_stage_product``; its factors are joined as tables, by block."""
    f = materialize(qa_features(spark, d), "qa-features")  # read for its width, its sums and its count
    n = float(f.count())
    model, s, _ = WC.fit(f, "qv", "av", block=block)
    scaled = F.transform("w", lambda x, j: x * F.element_at(F.array(*[F.lit(float(v)) for v in s]), j + 1) * n ** 6)
    q = model.where(F.col("side") == "q").select(F.col("idx").cast("int").alias("i"), scaled.alias("w"))
    a = model.where(F.col("side") == "a").select((F.col("idx") / block).cast("int").alias("jb"), "idx", "w")
    cols = a.groupBy("jb").agg(F.collect_list(F.struct("idx", "w")).alias("cols"))  # block rows each
    blocks = -(-WC.widths(f, "qv", "av")[1] // block)
    rows = q.withColumn("jb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(cols, "jb")
    dot = F.aggregate(F.zip_with("w", "c.w", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return rows.select("i", "w", F.explode("cols").alias("c")).select(
        "i", F.col("c.idx").cast("int").alias("j"), (F.round(dot, 6) + 0.0).alias("v"))
