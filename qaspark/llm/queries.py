"""The registered queries of this package and, where SQL can say it, their
DuckDB statements. Each query applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from qaspark.llm import (ann, bpe, fingerprints, hard_negatives, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, toxicity,
                         whitening)
from qaspark.llm.common import fold_is, materialize, order_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- 2: quality rules ------------------------------------------------------

_MEASURE_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
g3 AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM g2 WHERE c > 1),
g4 AS (SELECT rid, count(*) AS n FROM g3 GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(g4.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN g4 ON w.rid = g4.rid),
r AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             10 * n_symbols > n_words AS f2, 10 * n_dup_lines > 3 * n_lines AS f3,
             (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS f4 FROM m),
h AS (SELECT source, count(*) AS n, unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS rule,
             unnest([sum(base_failed::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)]) AS f
      FROM r WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT rule, sum(f) / sum(n) AS mean, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h GROUP BY rule),
k AS (SELECT h.source, (f + mean * wt) / (n + wt) AS rate
      FROM h JOIN (SELECT rule, mean, least(greatest(mean * (1 - mean) /
                          greatest(v - mean * (1 - mean) * inv, 1e-12) - 1, 1.0), 1e6) AS wt FROM p) q
        ON h.rule = q.rule),
bad AS (SELECT DISTINCT source FROM k WHERE rate >= 0.5),
verdict AS (SELECT r.*, NOT base_failed AND NOT ((f2 OR f3 OR f4) AND source IS NOT NULL
                       AND source IN (SELECT source FROM bad)) AS kept FROM r)"""

QUALITY_SQL = ("WITH " + _MEASURE_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict""")


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.MEASURES, "base_failed", "kept")


# --- 3: line dedup ---------------------------------------------------------

LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS ord,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, ord, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(ord) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
x AS (SELECT rid, line, pos, coalesce(k.ord > f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key),
a AS (SELECT rid, sum(gone::INT)::BIGINT AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
      FROM x GROUP BY rid)
SELECT doc_id, len(ls)::BIGINT AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN a ON d.rid = a.rid"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# --- 4: byte-level BPE -----------------------------------------------------

@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


# --- 9: best-fit packing ---------------------------------------------------

@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("uid")


# --- 1: language identification --------------------------------------------

@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(~fold_is("doc_id", 5, 0)))
    return language_id.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


# --- 8: toxicity -----------------------------------------------------------

@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable=~fold_is("doc_id", 3, 1))
    return toxicity.score(docs, index).select(
        "doc_id", fold_is("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


# --- 10: substring dedup ---------------------------------------------------

@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# --- 6: n-gram Jaccard join ------------------------------------------------

@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ngram_join.near_duplicates(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", order_id("doc_id").alias("ord"), F.xxhash64(text).alias("th"))
            .join(found.dropDuplicates(["ord", "th"]), ["ord", "th"])
            .select("doc_id", "class_id", "rep_id", "n_links", "n_copies"))


# --- 7: approximate nearest neighbours -------------------------------------

@query("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(table(spark, sf_dir, "embeddings"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(index, F.col("id") % 50 == 0)


# --- 5: suffix-array dedup -------------------------------------------------

@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# --- 11: embedding whitening -----------------------------------------------

@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.whole_numbers(F.col("embedding"), 1024, 100_000).alias("x"))
    rows = whitening.usable(rows, "x")
    model = whitening.fit(rows, "x", 8)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    white = materialize(whitening.apply(rows, model, "x").drop("x"), "whitened")
    error = whitening.identity_error(white, len(model.values))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


# --- 12: hard-negative mining ----------------------------------------------

@query("op12_hard_negatives")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), whitening.whole_numbers(F.col("embedding"), 256, 0).alias("embedding"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


# --- 13: document fingerprints ---------------------------------------------

@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


# --- the pipeline ----------------------------------------------------------

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
