"""Text normaliser queries over every text of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.sources.tables import table

# Literal sentences appended to the texts (the tables hold no money, clock
# time or apostrophes); the suffix is picked by id modulo their count.
SUFFIXES = [
    "",
    " meet on May 5th 2010 at 10:30 pm for $ 3,000.50 or 20 %",
    " born-in",
    " mail a.b@c.com now 5 ml",
    " the 3 rd of 4 it's",
    " it may rain ABC 12",
]


def _texts(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").cast("string").alias("id"),
                                                  F.col("doc_id").alias("n"), "text")
    conv = table(spark, d, "conversations").select(
        F.lit("conv").alias("src"), F.concat_ws("-", "conv_id", "turn").alias("id"),
        (F.col("conv_id") + F.col("turn")).alias("n"), "text")
    bench = table(spark, d, "benchmark").select(F.lit("bench").alias("src"), F.col("item_id").cast("string").alias("id"),
                                                   F.col("item_id").alias("n"), "text")
    u = docs.unionByName(conv).unionByName(bench)
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("n") % len(SUFFIXES) + 1).cast("int"))
    return u.select("src", "id", F.concat("text", suffix).alias("text"))


def _duck_texts():
    arr = "[" + ", ".join(D.lit(s) for s in SUFFIXES) + "]"
    return ("texts", f"""
        SELECT src, id, text || {arr}[CAST(n % {len(SUFFIXES)} AS INTEGER) + 1] AS text FROM (
          SELECT 'doc' AS src, CAST(doc_id AS VARCHAR) AS id, doc_id AS n, text FROM documents
          UNION ALL SELECT 'conv', conv_id || '-' || turn, conv_id + turn, text FROM conversations
          UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), item_id, text FROM benchmark)""")


@query("text_tokenize", D.with_fx(f"SELECT src, id, {D.tokenize('text')} AS out FROM texts", extra=[_duck_texts()]))
def text_tokenize(spark, d):
    return _texts(spark, d).select("src", "id", T.tokenize("text").alias("out"))


@query("text_no_symbol", D.with_fx(f"SELECT src, id, {D.no_symbol('text')} AS out FROM texts", extra=[_duck_texts()]))
def text_no_symbol(spark, d):
    return _texts(spark, d).select("src", "id", T.no_symbol("text").alias("out"))


@query("text_capitalize", D.with_fx(f"SELECT src, id, {D.clean_question('text')} AS out FROM texts",
                                    extra=[_duck_texts()]))
def text_capitalize(spark, d):
    return _texts(spark, d).select("src", "id", T.clean_question("text").alias("out"))


_DUCK_NGRAMS = D.with_fx("""
SELECT t.src, t.id, k.n, coalesce(a.grams, '') AS grams, coalesce(a.n_grams, 0) AS n_grams
FROM texts t CROSS JOIN (VALUES (1), (2), (3)) k(n)
LEFT JOIN (
  SELECT src, id, n, string_agg(g, chr(9) ORDER BY pos) AS grams, CAST(count(g) AS BIGINT) AS n_grams
  FROM (SELECT src, id, pos, 1 AS n, g1 AS g FROM grams
        UNION ALL SELECT src, id, pos, 2, g2 FROM grams
        UNION ALL SELECT src, id, pos, 3, g3 FROM grams)
  WHERE g IS NOT NULL GROUP BY src, id, n) a ON a.src = t.src AND a.id = t.id AND a.n = k.n""",
    extra=[_duck_texts(),
           ("toks", f"SELECT src, id, {D.split_ws('text')} AS toks FROM texts"),
           ("long", "SELECT src, id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM toks"),
           ("grams", """SELECT src, id, pos, tok AS g1,
                               tok || ' ' || lead(tok, 1) OVER w AS g2,
                               tok || ' ' || lead(tok, 1) OVER w || ' ' || lead(tok, 2) OVER w AS g3
                        FROM long WINDOW w AS (PARTITION BY src, id ORDER BY pos)""")])


@query("text_ngrams", _DUCK_NGRAMS)
def text_ngrams(spark, d):
    t = _texts(spark, d).select("src", "id", T.split_ws("text").alias("toks"))
    parts = [t.select("src", "id", F.lit(n).alias("n"), T.ngrams("toks", n).alias("g")) for n in (1, 2, 3)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select("src", "id", "n", F.array_join("g", "\t").alias("grams"),
                    F.size("g").cast("long").alias("n_grams"))
