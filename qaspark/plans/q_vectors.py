"""Word-vector queries: UNKNOWN vector, sentence means, QA cosine distance (flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.operators import vectors as VEC
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.sources import fixtures as X


def unknown_for(spark, d, vectors=None):
    vectors = vectors if vectors is not None else X.word_vectors(spark, d)
    counts = X.corpus_token_counts(spark, d)
    return VEC.unknown_values(counts, vectors, VEC.width(vectors))


def pair_vectors(spark, d, vectors=None, unknown=None):
    """Mean vectors of every conversation QA pair, both sides, long by side."""
    vectors = vectors if vectors is not None else X.word_vectors(spark, d)
    unknown = unknown if unknown is not None else unknown_for(spark, d, vectors)
    p = X.qa_pairs(spark, d)
    p = p.select("conv_id", "turn", T.split_ws("q").alias("qt"), T.answer_tokens("a").alias("at"))
    sents = VEC.long_sides(p, ["conv_id", "turn"], {"q": "qt", "a": "at"})
    return VEC.sentence_vectors(sents, ["conv_id", "turn", "side"], "tokens", vectors, unknown)


def qa_distance(spark, d):
    from qaspark.functions.vector import cosine_distance
    pv = VEC.pivot_sides(pair_vectors(spark, d), ["conv_id", "turn"], {"qv": "q", "av": "a"})
    return pv.select("conv_id", "turn", cosine_distance("qv", "av").alias("dist"))


# ---- DuckDB ---------------------------------------------------------------

_DUCK_UNK = [
    ("clines", "SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents"),
    ("ccount", f"SELECT token, count(*) AS n FROM (SELECT unnest({D.split_ws(D.no_symbol('line'))}) AS token FROM clines) GROUP BY token"),
    ("rare", "SELECT w.token, w.vec FROM ccount c JOIN fx_word_vectors w ON c.token = w.token WHERE c.n <= 4"),
    ("unk_dims", """SELECT i, avg(x) AS x FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM rare)
                    GROUP BY i"""),
    ("dims", "SELECT unnest(generate_series(1, (SELECT max(len(vec)) FROM fx_word_vectors))) AS i"),
    ("unk", "SELECT list(coalesce(u.x, 0.0) ORDER BY dims.i) AS vec FROM dims LEFT JOIN unk_dims u ON u.i = dims.i"),
]

_DUCK_SENT = _DUCK_UNK + [
    ("sent", f"""SELECT conv_id, turn, 'q' AS side, {D.split_ws('q')} AS toks FROM fx_pairs
                 UNION ALL
                 SELECT conv_id, turn, 'a', flatten(list_transform(string_split(a, '|'), lambda p: {D.split_ws('p')}))
                 FROM fx_pairs"""),
    ("words", "SELECT conv_id, turn, side, unnest(toks) AS token FROM sent"),
    ("wv", """SELECT w.conv_id, w.turn, w.side, coalesce(v.vec, (SELECT vec FROM unk)) AS vec
              FROM words w LEFT JOIN fx_word_vectors v ON v.token = w.token"""),
    ("live", "SELECT * FROM wv WHERE len(list_filter(vec, lambda x: x <> 0)) > 0"),
    ("mean_dims", """SELECT conv_id, turn, side, i, avg(x) AS x
                     FROM (SELECT conv_id, turn, side, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM live)
                     GROUP BY conv_id, turn, side, i"""),
    ("sv", """SELECT s.conv_id, s.turn, s.side, dims.i, coalesce(m.x, 0.0) AS x
              FROM sent s CROSS JOIN dims
              LEFT JOIN mean_dims m ON m.conv_id = s.conv_id AND m.turn = s.turn AND m.side = s.side AND m.i = dims.i"""),
]


@query("unknown_vector", D.with_fx(
    "SELECT CAST(i AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM unk)",
    "fx_word_vectors", extra=_DUCK_UNK))
def unknown_vector(spark, d):
    vectors = X.word_vectors(spark, d)
    counts = X.corpus_token_counts(spark, d)
    u = VEC.unknown_vector(counts, vectors)
    zeros = F.array_repeat(F.lit(0.0), vectors.select(F.max(F.size("vec"))).scalar())
    return u.select(F.posexplode(F.coalesce("vec", zeros)).alias("dim", "value")).select(
        F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("low_frequency_tokens", D.with_fx("SELECT token FROM rare", "fx_word_vectors", extra=_DUCK_UNK))
def low_frequency_tokens(spark, d):
    vectors = X.word_vectors(spark, d)
    counts = X.corpus_token_counts(spark, d)
    return VEC.low_frequency_tokens(counts, vectors)


@query("avg_embedding", D.with_fx(
    "SELECT conv_id, turn, side, CAST(i - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM sv",
    "fx_word_vectors", "fx_pairs", extra=_DUCK_SENT))
def avg_embedding(spark, d):
    pv = pair_vectors(spark, d)
    return pv.select("conv_id", "turn", "side", F.posexplode("vec").alias("dim", "value")).select(
        "conv_id", "turn", "side", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("qa_cosine", D.with_fx("""
SELECT q.conv_id, q.turn,
       round(1 - sum(q.x * a.x) / nullif(sqrt(sum(q.x * q.x)) * sqrt(sum(a.x * a.x)), 0), 6) AS dist
FROM sv q JOIN sv a ON a.conv_id = q.conv_id AND a.turn = q.turn AND a.i = q.i AND a.side = 'a'
WHERE q.side = 'q'
GROUP BY q.conv_id, q.turn""", "fx_word_vectors", "fx_pairs", extra=_DUCK_SENT))
def qa_cosine(spark, d):
    return qa_distance(spark, d).select("conv_id", "turn", F.round("dist", 6).alias("dist"))
