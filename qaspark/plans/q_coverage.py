"""Coverage, overlap and coverage-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.operators import coverage as C
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.plans.q_generate import _DUCK_TEST_LINES
from qaspark.plans.q_vocab import _duck_test_tokens, test_rows
from qaspark.sources import fixtures as X


def dataset_tokens(spark, d):
    p = X.qa_pairs(spark, d)
    t = test_rows(spark, d, "raw_token")
    pp = X.paraphrase_pairs(spark, d)
    parts = [
        p.select(F.lit("qa_train").alias("dataset"), F.explode(T.split_ws("q")).alias("token")),
        p.select(F.lit("qa_train").alias("dataset"), F.explode(T.answer_tokens("a")).alias("token")),
        t.select(F.lit("qa_test").alias("dataset"), F.explode("q").alias("token")),
        t.select(F.lit("qa_test").alias("dataset"), F.explode("a").alias("token")),
        pp.select(F.lit("paraphrase").alias("dataset"), F.explode(T.split_ws(T.no_symbol("q1"))).alias("token")),
        pp.select(F.lit("paraphrase").alias("dataset"), F.explode(T.split_ws(T.no_symbol("q2"))).alias("token")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _models(spark, d):
    return [("main", X.model_main(spark, d)), ("other", X.model_other(spark, d))]


def _duck_tokens():
    test = _duck_test_tokens()[len(_DUCK_TEST_LINES):len(_DUCK_TEST_LINES) + 2]
    ans = "flatten(list_transform(string_split(a, '|'), lambda p: " + D.split_ws("p") + "))"
    return _DUCK_TEST_LINES + test + [("toks", f"""
        SELECT 'qa_train' AS dataset, unnest({D.split_ws('q')}) AS token FROM fx_pairs
        UNION ALL SELECT 'qa_train', unnest({ans}) FROM fx_pairs
        UNION ALL SELECT 'qa_test', unnest(qt) FROM trows
        UNION ALL SELECT 'qa_test', unnest(ans) FROM trows
        UNION ALL SELECT 'paraphrase', unnest({D.split_ws(D.no_symbol('q1'))}) FROM fx_paraphrases
        UNION ALL SELECT 'paraphrase', unnest({D.split_ws(D.no_symbol('q2'))}) FROM fx_paraphrases"""),
        ("mt", "SELECT DISTINCT 'main' AS model, token FROM fx_model_main "
               "UNION ALL SELECT DISTINCT 'other', token FROM fx_model_other")]


@query("coverage_report", D.with_fx("""
SELECT model, dataset, unseen_occ, total_occ, round(unseen_occ * 100.0 / total_occ, 6) AS pct_occ,
       unseen_tok, total_tok, round(unseen_tok * 100.0 / total_tok, 6) AS pct_tok
FROM (
  SELECT g.model, ds.dataset,
         count(*) FILTER (WHERE x.token IS NULL) AS unseen_occ, count(*) AS total_occ,
         count(DISTINCT t.token) FILTER (WHERE x.token IS NULL) AS unseen_tok, count(DISTINCT t.token) AS total_tok
  FROM (SELECT DISTINCT model FROM mt) g(model)
  CROSS JOIN (SELECT DISTINCT dataset FROM toks) ds(dataset)
  JOIN toks t ON t.dataset = ds.dataset
  LEFT JOIN mt x ON x.model = g.model AND x.token = t.token
  GROUP BY g.model, ds.dataset) s(model, dataset, unseen_occ, total_occ, unseen_tok, total_tok)""",
                                    "fx_triples", "fx_pairs", "fx_paraphrases", "fx_model_main", "fx_model_other",
                                    extra=_duck_tokens()))
def coverage_report(spark, d):
    c = C.coverage(dataset_tokens(spark, d), _models(spark, d))
    return c.select("model", "dataset", "unseen_occ", "total_occ", F.round("pct_occ", 6).alias("pct_occ"),
                    "unseen_tok", "total_tok", F.round("pct_tok", 6).alias("pct_tok"))


@query("overlap_report", D.with_fx("""
SELECT 'total' AS metric, '' AS model, count(*) AS value FROM (SELECT token FROM mt GROUP BY token)
UNION ALL
SELECT 'shared', '', count(*) FROM (SELECT token FROM mt GROUP BY token HAVING count(DISTINCT model) = 2)
UNION ALL
SELECT 'missing', m.model, (SELECT count(*) FROM (SELECT DISTINCT token FROM mt) a
                             WHERE a.token NOT IN (SELECT token FROM mt b WHERE b.model = m.model))
FROM (SELECT DISTINCT model FROM mt) m""", "fx_model_main", "fx_model_other",
                                   extra=[("mt", "SELECT DISTINCT 'main' AS model, token FROM fx_model_main "
                                                 "UNION ALL SELECT DISTINCT 'other', token FROM fx_model_other")]))
def overlap_report(spark, d):
    return C.overlap(_models(spark, d))


_ANS = "flatten(list_transform(string_split(lower(a), '|'), lambda p: " + D.split_ws("p") + "))"


@query("coverage_filter", D.with_fx(f"""
SELECT p.conv_id, p.turn, p.q, p.a, coalesce(m.misses, 0) AS misses
FROM fx_pairs p LEFT JOIN (
  SELECT conv_id, turn, count(*) AS misses FROM (
    SELECT conv_id, turn, unnest({D.split_ws('lower(q)')}) AS token FROM fx_pairs
    UNION ALL SELECT conv_id, turn, unnest({_ANS}) FROM fx_pairs) w
  WHERE token NOT IN (SELECT token FROM fx_covered)
  GROUP BY conv_id, turn) m ON m.conv_id = p.conv_id AND m.turn = p.turn
WHERE coalesce(m.misses, 0) < 2""", "fx_pairs", "fx_covered"))
def coverage_filter(spark, d):
    # The covered vocabulary is lower-cased, so are the pair tokens here.
    p = (X.qa_pairs(spark, d).withColumn("qt", T.split_ws(F.lower("q")))
         .withColumn("at", T.answer_tokens(F.lower("a"))))
    out = C.filter_covered(p, ["conv_id", "turn"], ["qt", "at"], X.covered_tokens(spark, d))
    return out.select("conv_id", "turn", "q", "a", "misses")
