"""Circular-correlation queries: pairwise, answer structure, sentence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.functions import vector as V
from qaspark.operators import generate as G
from qaspark.operators import holographic as H
from qaspark.operators import vectors as VEC
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.plans.q_generate import _DUCK_TEST_LINES
from qaspark.plans.q_vectors import _DUCK_UNK, unknown_for
from qaspark.sources import fixtures as X


def _duck_cc(a: str, b: str) -> str:
    """DuckDB circular correlation of two DOUBLE[] expressions (zero operand = identity)."""
    full = (f"list_transform(range(0, len({a})), lambda k: list_sum(list_transform(range(0, len({a})), "
            f"lambda i: {a}[i + 1] * {b}[((k + i) % len({a})) + 1])))")
    return (f"(CASE WHEN len(list_filter({a}, lambda z: z <> 0)) = 0 THEN {b} "
            f"WHEN len(list_filter({b}, lambda z: z <> 0)) = 0 THEN {a} ELSE {full} END)")


_DUCK_PAIRS = [("pairs", """
    SELECT x.idx, x.vec AS a,
           CASE WHEN x.idx % 50 = 0 THEN list_transform(y.vec, lambda v: 0.0) ELSE y.vec END AS b
    FROM fx_clustered x JOIN fx_clustered y ON y.idx = x.idx + 1""")]


@query("circular_correlation", D.with_fx(f"""
SELECT idx, CAST(k - 1 AS BIGINT) AS dim, round(c[k], 6) + 0.0 AS value
FROM (SELECT idx, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT idx, {_duck_cc('a', 'b')} AS c FROM pairs))""",
                                         "fx_clustered", extra=_DUCK_PAIRS))
def circular_correlation(spark, d):
    c = X.clustered(spark, d)
    width = VEC.width(c)
    x = c.select("idx", F.col("vec").alias("a"))
    y = c.select((F.col("idx") - 1).alias("idx"), F.col("vec").alias("b"), (F.col("idx") - 1).alias("i0"))
    p = x.join(y, "idx").withColumn(
        "b", F.when(F.col("idx") % 50 == 0, V.zeros(width)).otherwise(F.col("b")))
    out = p.select("idx", H.correlation_udf()("a", "b").alias("c"))
    return out.select("idx", F.posexplode("c").alias("dim", "value")).select(
        "idx", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("answer_holographic", D.with_fx(f"""
SELECT idx, CAST(k - 1 AS BIGINT) AS dim, round(h[k], 6) + 0.0 AS value
FROM (SELECT idx, h, unnest(range(1, len(h) + 1)) AS k FROM (
  SELECT idx, {_duck_cc('rr', 'ee')} AS h FROM parts))""", "fx_clustered", extra=[
    ("quad", """SELECT a.idx, a.vec AS e1, b.vec AS r1, c.vec AS r2, e.vec AS e2
               FROM fx_clustered a JOIN fx_clustered b ON b.idx = a.idx + 1
                    JOIN fx_clustered c ON c.idx = a.idx + 2 JOIN fx_clustered e ON e.idx = a.idx + 3"""),
    ("parts", f"MATERIALIZED (SELECT idx, {_duck_cc('r1', 'r2')} AS rr, {_duck_cc('e1', 'e2')} AS ee FROM quad)"),
]))
def answer_holographic(spark, d):
    """Answers ``e1|r1 r2|e2`` over consecutive vocabulary words with their
    own vectors: ``fold(r) * (fold(e1) * fold(e2))``, FFT path (O(d log d)
    per step)."""
    c = X.clustered(spark, d).select("idx", "vec")
    width = VEC.width(c)
    def at(off, name):
        return c.select((F.col("idx") - off).alias("idx"), F.col("vec").alias(name))
    j = at(0, "e1").join(at(1, "r1"), "idx").join(at(2, "r2"), "idx").join(at(3, "e2"), "idx")
    s = j.select("idx", F.array("e1").alias("e1"), F.array("r1", "r2").alias("r"), F.array("e2").alias("e2"))
    h = s.select("idx", H.structure_udf(width)("e1", "r", "e2").alias("h"))
    return h.select("idx", F.posexplode("h").alias("dim", "value")).select(
        "idx", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


def _duck_fold(vs: str) -> str:
    """Left fold of the circular correlation over a list of vectors."""
    return f"list_reduce({vs}, lambda x, y: {_duck_cc('x', 'y')})"


_DUCK_WORDS = _DUCK_UNK + [
    ("hw", f"""SELECT w.conv_id, w.turn, w.pos, coalesce(v.vec, (SELECT vec FROM unk)) AS vec FROM (
                 SELECT conv_id, turn, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
                 FROM (SELECT conv_id, turn, {D.split_ws('lower(q)')} AS toks FROM fx_pairs)) w
               LEFT JOIN fx_word_vectors v ON v.token = w.token"""),
    ("hl", "SELECT conv_id, turn, list(vec ORDER BY pos) AS vs FROM hw GROUP BY conv_id, turn"),
    ("hf", f"MATERIALIZED (SELECT conv_id, turn, {_duck_fold('vs')} AS h FROM hl)"),
]


@query("holographic_features", D.with_fx("""
SELECT p.conv_id, p.turn, dims.i - 1 AS dim, round(coalesce(hf.h[dims.i], 0.0), 6) + 0.0 AS value
FROM fx_pairs p CROSS JOIN dims LEFT JOIN hf ON hf.conv_id = p.conv_id AND hf.turn = p.turn""",
                                         "fx_word_vectors", "fx_pairs", extra=_DUCK_WORDS))
def holographic_features(spark, d):
    """Flat holographic fold over every word of every QA-pair question (FFT path)."""
    vectors = X.word_vectors(spark, d)
    unknown = unknown_for(spark, d, vectors)
    p = X.qa_pairs(spark, d).select("conv_id", "turn", T.split_ws(F.lower("q")).alias("tokens"))
    h = H.sentence_holographic(p, ["conv_id", "turn"], "tokens", vectors, unknown)
    return h.select("conv_id", "turn", F.posexplode("vec").alias("dim", "value")).select(
        "conv_id", "turn", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


_DUCK_NESTED = _DUCK_WORDS[:len(_DUCK_UNK) + 1] + [
    ("hp", "SELECT *, (pos - 1) // 4 AS c, (pos - 1) % 4 AS p FROM hw"),
    ("hu", f"MATERIALIZED (SELECT conv_id, turn, c, {_duck_fold('list(vec ORDER BY pos)')} AS u FROM hp WHERE p >= 2 GROUP BY conv_id, turn, c)"),
    ("hs", f"""MATERIALIZED (SELECT t.conv_id, t.turn, t.c, CASE WHEN u IS NULL THEN t.vec ELSE {_duck_cc('t.vec', 'u')} END AS s
               FROM hp t LEFT JOIN hu ON hu.conv_id = t.conv_id AND hu.turn = t.turn AND hu.c = t.c WHERE t.p = 1)"""),
    ("hc", f"""MATERIALIZED (SELECT t.conv_id, t.turn, t.c, CASE WHEN s IS NULL THEN t.vec ELSE {_duck_cc('t.vec', 's')} END AS v
               FROM hp t LEFT JOIN hs ON hs.conv_id = t.conv_id AND hs.turn = t.turn AND hs.c = t.c WHERE t.p = 0)"""),
    ("hn", f"MATERIALIZED (SELECT conv_id, turn, {_duck_fold('list(v ORDER BY c)')} AS h FROM hc GROUP BY conv_id, turn)"),
]


@query("holographic_nested", D.with_fx("""
SELECT p.conv_id, p.turn, dims.i - 1 AS dim, round(coalesce(hn.h[dims.i], 0.0), 6) + 0.0 AS value
FROM fx_pairs p CROSS JOIN dims LEFT JOIN hn ON hn.conv_id = p.conv_id AND hn.turn = p.turn""",
                                       "fx_word_vectors", "fx_pairs", extra=_DUCK_NESTED))
def holographic_nested(spark, d):
    """Fold over nested lists: the words of every question in fours, each
    ``[w0, [w1, [w2, w3]]]`` as far as it has words."""
    vectors = X.word_vectors(spark, d)
    unknown = unknown_for(spark, d, vectors)
    ids = ["conv_id", "turn"]
    q = X.qa_pairs(spark, d).select(*ids, T.split_ws(F.lower("q")).alias("tokens"))
    words = q.select(*ids, F.posexplode("tokens").alias("pos", "token"))
    four, p = F.floor(F.col("pos") / 4).cast("string"), F.col("pos") % 4
    kind = F.when(p == 0, "c").when(p == 1, "s").otherwise("u")
    leaves = words.select(*ids, F.concat(F.lit("w"), "pos").alias("node"), F.concat(kind, four).alias("parent"), "pos", "token")
    # A list begins with its first word and stands behind the word before it.
    lists = words.where(p <= 2).select(*ids, F.concat(kind, four).alias("node"), F.when(p == 1, F.concat(F.lit("c"), four)).when(
        p == 2, F.concat(F.lit("s"), four)).alias("parent"), "pos", F.lit(None).cast("string").alias("token"))
    nodes = leaves.unionByName(lists).withColumnRenamed("pos", "ord")
    h = H.fold_tree(q, nodes, ids, vectors, unknown)
    return h.select(*ids, F.posexplode("vec").alias("dim", "value")).select(
        *ids, F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


_DUCK_ANSWERS = _DUCK_UNK + _DUCK_TEST_LINES + [
    ("ans", f"""SELECT row_id, part, list_filter(regexp_split_to_array(lower(txt), '\\s+'), lambda x: x <> '') AS toks FROM (
                  SELECT row_id, unnest(['e1', 'r', 'e2']) AS part,
                         unnest([{D.no_symbol('parts[2]')}, {D.no_symbol('parts[1]')},
                                 {D.no_symbol("CASE WHEN np = 3 THEN parts[3] ELSE 'PLACEHOLDER' END")}]) AS txt
                  FROM tp2 WHERE reject IS NULL)"""),
    ("aw", """SELECT w.part, w.toks, w.pos, coalesce(v.vec, (SELECT vec FROM unk)) AS vec FROM (
                SELECT part, toks, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
                FROM (SELECT DISTINCT part, toks FROM ans)) w LEFT JOIN fx_word_vectors v ON v.token = w.token"""),
    ("al", "SELECT part, toks, list(vec ORDER BY pos) AS vs FROM aw GROUP BY part, toks"),
    ("af", f"MATERIALIZED (SELECT part, toks, {_duck_fold('vs')} AS h FROM al)"),
    ("zero", "SELECT list(0.0::DOUBLE) AS z FROM dims"),
    ("ap", """SELECT a.row_id, max(CASE WHEN a.part = 'e1' THEN coalesce(f.h, zero.z) END) AS e1,
                     max(CASE WHEN a.part = 'r' THEN coalesce(f.h, zero.z) END) AS r,
                     max(CASE WHEN a.part = 'e2' THEN coalesce(f.h, zero.z) END) AS e2
              FROM ans a CROSS JOIN zero LEFT JOIN af f ON f.part = a.part AND f.toks = a.toks GROUP BY a.row_id"""),
    ("ae", f"MATERIALIZED (SELECT row_id, r, {_duck_cc('e1', 'e2')} AS ee FROM ap)"),
    ("ah", f"MATERIALIZED (SELECT row_id, {_duck_cc('r', 'ee')} AS h FROM ae)"),
]


@query("holographic_answers", D.with_fx("""
SELECT row_id, dim, round(h[dim + 1], 6) + 0.0 AS value
FROM (SELECT row_id, h, CAST(unnest(range(0, len(h))) AS BIGINT) AS dim FROM ah)""",
                                        "fx_triples", "fx_word_vectors", extra=_DUCK_ANSWERS))
def holographic_answers(spark, d):
    """Structured answers ``e1|r|e2`` of the test rows, entities of any number of
    words: ``fold(r) * (fold(e1) * fold(e2))``."""
    vectors = X.word_vectors(spark, d)
    unknown = unknown_for(spark, d, vectors)
    t = G.test_pairs(X.test_label_lines(spark, d), X.cluster_id_lines(spark, d)).where(F.col("reject").isNull())
    f = F.split(F.lower("a"), r"\|")
    rows = t.select("row_id", *[T.split_ws(F.get(f, i)).alias(p) for i, p in enumerate(("e1", "r", "e2"))])
    h = H.answer_holographic(rows, ["row_id"], {p: p for p in ("e1", "r", "e2")}, vectors, unknown)
    return h.select("row_id", F.posexplode("vec").alias("dim", "value")).select(
        "row_id", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))
