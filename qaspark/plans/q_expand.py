"""Vocabulary expansion queries: in-cluster neighbours, centroids, fallback chain, token set."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.operators import generate as G
from qaspark.operators import kmeans as KM
from qaspark.operators import neighbors as NB
from qaspark.operators import pivots as PV
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.plans.q_generate import TAB, _duck_answer_tokens, _duck_train_lines
from qaspark.session import materialize
from qaspark.sources import fixtures as X


def _other_labelled(spark, d):
    lab = X.clustered(spark, d).select("token", "label")
    return X.model_other(spark, d).join(lab, "token")


_DUCK_O = [("o", """SELECT o.token, c.label, o.vec FROM fx_model_other o JOIN fx_clustered c ON c.token = o.token"""),
           ("near", """SELECT a.token AS qtoken, b.token, round(1 - list_cosine_similarity(a.vec, b.vec), 6) AS dist
                       FROM o a JOIN o b ON a.label = b.label AND a.token <> b.token""")]


_DUCK_TOPK = D.with_fx("""
SELECT qtoken, rank, token, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qtoken ORDER BY dist, token) AS rank FROM near)
WHERE rank <= 5""", "fx_model_other", "fx_clustered", extra=_DUCK_O)


@query("cluster_topk", _DUCK_TOPK)
def cluster_topk(spark, d):
    o = _other_labelled(spark, d)
    q = o.select(F.col("token").alias("qtoken"), "label", F.col("vec").alias("qvec"))
    r = NB.topk_in_group(q, o.select("token", "label", "vec"), NB.TOP)
    return r.select("qtoken", F.col("rank").cast("long").alias("rank"), "token", F.round("dist", 6).alias("dist"))


def pruned_search(spark, d, cell_rows: int = 128):
    o = materialize(_other_labelled(spark, d), "other-labelled")
    return PV.topk_pruned(o.select(F.col("token").alias("qtoken"), "label", F.col("vec").alias("qvec")),
                          o.select("token", "label", "vec"), NB.TOP, cell_rows=cell_rows)


@query("cluster_topk_pruned", _DUCK_TOPK)
def cluster_topk_pruned(spark, d):
    """``cluster_topk`` by pivots and radius bounds: cells of some 128 words that the bounds exclude are not read."""
    return pruned_search(spark, d).rows.select("qtoken", F.col("rank").cast("long").alias("rank"), "token",
                                               F.round("dist", 6).alias("dist"))


def expansion(spark, d):
    toks = X.clustered(spark, d).select("token")
    lab = X.clustered(spark, d).select("token", "label")
    return NB.expand_vocabulary(toks, X.model_main(spark, d), X.model_other(spark, d), lab)


_DUCK_EXPAND = _DUCK_O + [
    ("toks", "SELECT DISTINCT token FROM fx_clustered"),
    ("direct", "SELECT t.token, 'direct' AS how, t.token AS source FROM toks t JOIN fx_model_main m ON m.token = t.token"),
    ("need", "SELECT token FROM toks WHERE token NOT IN (SELECT token FROM fx_model_main)"),
    ("top5", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qtoken ORDER BY dist, token) AS rank
                               FROM near WHERE qtoken IN (SELECT token FROM need)) WHERE rank <= 5"""),
    ("best", """SELECT qtoken, arg_min(token, rank) AS source FROM top5
                WHERE token IN (SELECT token FROM fx_model_main) GROUP BY qtoken"""),
    ("expanded", "SELECT qtoken AS token, 'expanded' AS how, source FROM best"),
]


@query("vocab_expansion", D.with_fx("SELECT * FROM direct UNION ALL SELECT * FROM expanded",
                                    "fx_model_main", "fx_model_other", "fx_clustered", extra=_DUCK_EXPAND))
def vocab_expansion(spark, d):
    return expansion(spark, d).select("token", "how", "source")


@query("expansion_counts", D.with_fx("""
SELECT (SELECT count(*) FROM toks) AS tokens,
       (SELECT count(*) FROM direct) + (SELECT count(*) FROM expanded) AS found,
       (SELECT count(*) FROM expanded) AS expanded""", "fx_model_main", "fx_model_other", "fx_clustered",
                                     extra=_DUCK_EXPAND))
def expansion_counts(spark, d):
    e = expansion(spark, d).groupBy().agg(
        F.count(F.lit(1)).alias("found"),
        F.sum(F.when(F.col("how") == "expanded", 1).otherwise(0)).cast("long").alias("expanded"))
    n = X.clustered(spark, d).select("token").distinct().select(F.count(F.lit(1))).scalar()
    return e.select(n.alias("tokens"), "found", "expanded")


@query("assign_centroid", D.with_fx("""
SELECT token, label FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY dd, label) AS rn FROM (
    SELECT p.token, c.label, round(sqrt(sum((p.x - c.x) * (p.x - c.x))), 9) AS dd
    FROM (SELECT token, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM fx_clustered) p
    JOIN (SELECT label, i, avg(x) AS x FROM (
            SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM fx_clustered)
          GROUP BY label, i) c ON c.i = p.i
    GROUP BY p.token, c.label))
WHERE rn = 1""", "fx_clustered"))
def assign_centroid(spark, d):
    c = X.clustered(spark, d)
    return NB.assign_nearest(c.select("token", "vec"), NB.centroids(c))


@query("kmeans_groups")
def kmeans_groups(spark, d):
    """K-means over the other model's vectors, 30,000 groups or a tenth of the words;
    ``(token, label)``."""
    return KM.fit(X.model_other(spark, d)).rows.select("token", "label")


@query("kmeans_nearest", D.with_fx("SELECT token, true AS nearest FROM fx_model_other", "fx_model_other"))
def kmeans_nearest(spark, d):
    """Whether each word's group is the one whose centroid is nearest, found by
    comparing it with all centroids."""
    got = KM.fit(X.model_other(spark, d))
    best = NB.assign_nearest(got.rows.select("token", "vec"), got.centroids, KM.DECIMALS)
    return got.rows.select("token", F.col("label").alias("own")).join(best, "token").select("token", (F.col("own") == F.col("label")).alias("nearest"))


@query("token_set", D.with_fx(f"""
SELECT DISTINCT token FROM (
  SELECT unnest({D.split_ws('f[1]')}) AS token FROM (
    SELECT string_split({D.strip('value')}, {TAB}) AS f FROM train_lines) WHERE len(f) = 2
  UNION ALL
  SELECT unnest({_duck_answer_tokens('f[2]')}) FROM (
    SELECT string_split({D.strip('value')}, {TAB}) AS f FROM train_lines) WHERE len(f) = 2
  UNION ALL SELECT unnest({D.split_ws(D.no_symbol('q1'))}) FROM fx_paraphrases
  UNION ALL SELECT unnest({D.split_ws(D.no_symbol('q2'))}) FROM fx_paraphrases)""",
                                "fx_triples", "fx_paraphrases", extra=_duck_train_lines()))
def token_set(spark, d):
    tr = G.read_train(X.train_lines(spark, d), mode="raw_token")
    pp = G.read_paraphrases(X.paraphrase_lines(spark, d), mode="raw_token")
    # One pass over each set: a branch for each side would read and split all lines again.
    out = tr.select(F.explode(F.array("q", "a")).alias("toks")).unionByName(
        pp.select(F.explode(F.array("q1", "q2")).alias("toks")))
    return out.select(F.explode("toks").alias("token")).distinct()
