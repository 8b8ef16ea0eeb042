"""Sink/source round trips (written under the shared working folder, read
back) and the corpus union."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.operators import coverage as C
from qaspark.operators import features as FT
from qaspark.operators import generate as G
from qaspark.operators import vectors as VEC
from qaspark.plans import duck as D
from qaspark.plans import pipelines as P
from qaspark.plans.catalog import ORACLES, query
from qaspark.plans.q_coverage import _ANS
from qaspark.plans.q_generate import _duck_answer_tokens, _duck_pairs
from qaspark.plans.q_vectors import _DUCK_SENT, _DUCK_UNK
from qaspark.plans.q_vocab import _duck_test_tokens, _duck_vocab, test_rows, train_vocab
from qaspark.session import scratch_path, swept
from qaspark.sinks import files as K
from qaspark.sources import files as S
from qaspark.sources import fixtures as X


@query("corpus_union", D.with_fx(f"""
SELECT 'corpus' AS src, {D.key('doc_id', 'line_no')} AS sid, array_to_string(toks, ' ') AS tokens FROM (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line_no, {D.split_ws(D.no_symbol('unnest(lines)'))} AS toks
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS lines FROM documents))
WHERE len(toks) > 0
UNION ALL
SELECT 'para1', {D.key('conv_id', 'turn')}, array_to_string({D.split_ws(D.no_symbol('q1'))}, ' ') FROM fx_paraphrases
WHERE len({D.split_ws(D.no_symbol('q1'))}) > 0
UNION ALL
SELECT 'para2', {D.key('conv_id', 'turn')}, array_to_string({D.split_ws(D.no_symbol('q2'))}, ' ') FROM fx_paraphrases
WHERE len({D.split_ws(D.no_symbol('q2'))}) > 0""", "fx_paraphrases"))
def corpus_union(spark, d):
    lines = VEC.corpus_lines(X.corpus(spark, d)).select(
        F.lit("corpus").alias("src"), X.line_key(F.col("doc_id"), F.col("line_no")).alias("sid"), "tokens")
    pp = X.paraphrase_pairs(spark, d)
    sid = X.line_key(F.col("conv_id"), F.col("turn"))
    p1 = pp.select(F.lit("para1").alias("src"), sid.alias("sid"), T.split_ws(T.no_symbol("q1")).alias("tokens"))
    p2 = pp.select(F.lit("para2").alias("src"), sid.alias("sid"), T.split_ws(T.no_symbol("q2")).alias("tokens"))
    u = lines.unionByName(p1).unionByName(p2).filter(F.size("tokens") > 0)
    return u.select("src", "sid", F.array_join("tokens", " ").alias("tokens"))


_TAB = "chr(9)"


@query("roundtrip_pairs", D.with_fx(f"""
SELECT f[1] AS q, f[2] AS a FROM (SELECT string_split({D.strip(f"q || {_TAB} || a")}, {_TAB}) AS f FROM gen) WHERE len(f) = 2""",
                                    "fx_triples", extra=_duck_pairs("r")))
def roundtrip_pairs(spark, d):
    """Generated training pairs -> TSV -> read back through the line reader."""
    path = scratch_path(spark, "pairs")
    K.write_tsv(G.expand_triples(X.triples(spark, d)), path, ["q", "a"])
    lines = S.read_lines(spark, path)
    return G.read_train(lines, mode="raw").drop("row_id")


@query("roundtrip_matrix", D.with_fx("""
SELECT conv_id, turn, side, CAST(i - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM sv""",
                                     "fx_word_vectors", "fx_pairs", extra=_DUCK_SENT))
def roundtrip_matrix(spark, d):
    """Dense features written in row-bounded segments, read back, in long form."""
    path = scratch_path(spark, "matrix")
    K.write_segments(P.featurize(spark, d, "avg"), path, rows_per_file=100)
    sides = F.explode(F.array(F.struct(F.lit("q").alias("side"), F.col("qv").alias("v")),
                              F.struct(F.lit("a").alias("side"), F.col("av").alias("v")))).alias("s")
    long = S.read_table(spark, path).select("conv_id", "turn", sides)
    long = long.select("conv_id", "turn", "s.side", F.posexplode("s.v").alias("dim", "value"))
    return long.select("conv_id", "turn", "side", F.col("dim").cast("long").alias("dim"),
                       (F.round("value", 6) + 0.0).alias("value"))


def duck_pair_counts(grams: int, name: str = "feats") -> list[tuple[str, str]]:
    """n-gram counts of the conversation pairs with their own vocabulary."""
    q = "qt"
    if grams > 1:
        parts = " || ' ' || ".join(f"qt[i + {k}]" for k in range(grams))
        q = (f"CASE WHEN len(qt) >= {grams} THEN list_transform(range(1, len(qt) - {grams - 2}), lambda i: {parts}) ELSE [] END")
    return [
        (f"{name}_t", f"""SELECT {D.key('conv_id', 'turn')} AS row_id, {D.split_ws(D.tokenize('q'))} AS qt,
                          {_duck_answer_tokens(D.tokenize('a'))} AS ans FROM fx_pairs"""),
        (f"{name}_k", f"""SELECT row_id, 'q' AS side, unnest({q}) AS token FROM {name}_t
                          UNION ALL SELECT row_id, 'a', unnest(ans) FROM {name}_t"""),
        (f"{name}_f", f"SELECT side, token FROM {name}_k WHERE token <> 'UNKNOWN' GROUP BY ALL HAVING count(*) > 3"),
        (f"{name}_v", f"SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY token) AS idx FROM {name}_f"),
        (name, f"""SELECT k.row_id, k.side, coalesce(v.idx, 0) AS idx, count(*) AS cnt
                   FROM {name}_k k LEFT JOIN {name}_v v ON v.side = k.side AND v.token = k.token GROUP BY ALL"""),
    ]


@query("roundtrip_sparse", D.with_fx("SELECT * FROM feats", "fx_pairs", extra=duck_pair_counts(1)))
def roundtrip_sparse(spark, d):
    path = scratch_path(spark, "sparse")
    K.write_table(P.featurize(spark, d, "unigram"), path)
    return S.read_table(spark, path)


@query("roundtrip_model")
def roundtrip_model(spark, d):
    from qaspark.operators import cca as CCA
    path = scratch_path(spark, "model")
    m = CCA.fit(P.featurize(spark, d, "avg"), "qv", "av")
    K.write_table(m.to_df(spark), path)
    back = CCA.CCAModel.from_df(S.read_table(spark, path))
    return S.read_table(spark, path).withColumn("same", F.lit(bool((abs(back.q - m.q) < 1e-12).all())))


@query("roundtrip_vocab", D.with_fx("SELECT side, token, idx FROM vocab", "fx_triples", extra=_duck_vocab(1)))
def roundtrip_vocab(spark, d):
    path = scratch_path(spark, "vocab")
    K.write_table(train_vocab(spark, d, 1), path)
    return S.read_table(spark, path)


@query("roundtrip_converted", D.with_fx(f"""
SELECT row_id, array_to_string({D.split_ws(D.no_symbol('f[1]'))}, ' ') AS q1,
       array_to_string({D.split_ws(D.no_symbol('f[2]'))}, ' ') AS q2
FROM (SELECT {D.key('conv_id', 'turn')} AS row_id, string_split({D.strip(f"q1 || {_TAB} || q2")}, {_TAB}) AS f
      FROM fx_paraphrases) WHERE len(f) = 2""", "fx_paraphrases"))
def roundtrip_converted(spark, d):
    """Convert-and-write with skip-if-present: the second write is ignored."""
    path = scratch_path(spark, "converted")
    pp = G.read_paraphrases(X.paraphrase_lines(spark, d), mode="raw_token")
    out = pp.select("row_id", F.array_join("q1", " ").alias("q1"), F.array_join("q2", " ").alias("q2"))
    K.write_table(out, path, mode="ignore")
    K.write_table(out.limit(0), path, mode="ignore")
    return S.read_table(spark, path)


@query("roundtrip_filtered", f"""
SELECT array_to_string({D.split_ws('lower(q)')}, ' ') || {_TAB} || array_to_string({_ANS}, ' ') AS value
FROM ({ORACLES['coverage_filter']})""")
def roundtrip_filtered(spark, d):
    path = scratch_path(spark, "filtered")
    p = (X.qa_pairs(spark, d).withColumn("qt", T.split_ws(F.lower("q")))
         .withColumn("at", T.answer_tokens(F.lower("a"))))
    kept = C.filter_covered(p, ["conv_id", "turn"], ["qt", "at"], X.covered_tokens(spark, d))
    # Written as whitespace-joined tokens per side, one pair per line.
    kept = kept.select("conv_id", "turn", F.array_join("qt", " ").alias("q"), F.array_join("at", " ").alias("a"))
    K.write_tsv(kept, path, ["q", "a"], order=["conv_id", "turn"])
    return spark.read.text(path)


@query("roundtrip_vectors", D.with_fx("""
SELECT form, token, CAST(i - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value
FROM (SELECT form, token, unnest(vec) AS x, generate_subscripts(vec, 1) AS i
      FROM fx_word_vectors, (VALUES ('pipe'), ('w2v')) f(form))""", "fx_word_vectors"))
def roundtrip_vectors(spark, d):
    """Vectors as ``v1|v2|...`` text and in the header + lines word-vector
    format, read back, in long form."""
    v = X.word_vectors(spark, d)
    p1, p2 = scratch_path(spark, "vectext"), scratch_path(spark, "w2v")
    K.write_vectors_text(v, p1)
    K.write_word2vec_text(v, p2)
    a = S.read_vectors_text(spark, p1).select(F.lit("pipe").alias("form"), "token", "vec")
    b = S.read_word2vec_text(spark, p2).select(F.lit("w2v").alias("form"), "token", "vec")
    long = a.unionByName(b).select("form", "token", F.posexplode("vec").alias("dim", "value"))
    return long.select("form", "token", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("roundtrip_corpus", f"""
SELECT array_to_string({D.split_ws(D.no_symbol('line'))}, ' ') AS tokens
FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents)""")
def roundtrip_corpus(spark, d):
    """The corpus written as a directory of text files and read from there."""
    path = scratch_path(spark, "corpus")
    X.corpus(spark, d).where(F.col("text").isNotNull()).select("text").write.text(path)
    return S.read_corpus(spark, path).select(F.array_join("tokens", " ").alias("tokens"))


@query("roundtrip_unknown", D.with_fx("""
SELECT 'vector' AS kind, token, CAST(i - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM (
  SELECT token, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM (
    SELECT token, vec FROM fx_word_vectors WHERE token <> 'UNKNOWN' UNION ALL SELECT 'UNKNOWN', vec FROM unk))
UNION ALL SELECT 'rare', token, CAST(0 AS BIGINT), 0.0 FROM rare""", "fx_word_vectors", extra=_DUCK_UNK))
def roundtrip_unknown(spark, d):
    """The vector table with its UNKNOWN row and the rare-token list, written and read back."""
    vectors, p1, p2 = X.word_vectors(spark, d), scratch_path(spark, "with-unknown"), scratch_path(spark, "rare")
    K.write_table(VEC.with_unknown(vectors, P.unknown_of(spark, d, vectors)), p1)
    K.write_table(VEC.low_frequency_tokens(X.corpus_token_counts(spark, d), vectors), p2)
    long = S.read_table(spark, p1).select(F.lit("vector").alias("kind"), "token", F.posexplode("vec").alias("dim", "value"))
    rare = S.read_table(spark, p2).select(F.lit("rare").alias("kind"), "token", F.lit(0).alias("dim"), F.lit(0.0).alias("value"))
    return long.unionByName(rare).select("kind", "token", F.col("dim").cast("long").alias("dim"),
                                         (F.round("value", 6) + 0.0).alias("value"))


# ---- data sets in index and embedding form --------------------------------

def _train_indices(spark, d, grams=1):
    """The training pairs as text of vocabulary indices ``(row_id, q, a)``. The vocabulary comes from the distinct texts that the
    reader normalises, and those alone are indexed; the lines take the result by a join."""
    fields = G.train_fields(X.train_lines(spark, d))
    _, shared = VEC.split_shared(fields.select("row_id"), ["row_id"])

    def indexed(texts):
        sentences = [t.select(F.lit(side).alias("side"), "mult", F.col(side).alias("toks")) for side, t in texts.items()]
        vocab = train_vocab(spark, d, grams, sentences[0].unionByName(sentences[1]))
        out = {}
        for side, t in texts.items():
            t = G.with_ngrams(t, side, grams) if side == "q" else t
            got = FT.as_indices(t.select("text", side), {side: side}, vocab, "text", unique=True)
            # Rows that share an id are put together by place before they become text.
            out[side] = got if shared is not None else got.withColumn(side, FT.sentence_text(side, "index"))
        return out

    rows = G.read_train(None, mode="proc_token", grams=grams, fields=fields, represented=indexed)
    if shared is None:
        return rows
    got = FT.together(rows, {"q": "q", "a": "a"})
    return got.select("row_id", FT.sentence_text("q", "index").alias("q"), FT.sentence_text("a", "index").alias("a"))


def _duck_train_index(grams: int) -> list[tuple[str, str]]:
    q = "qt"
    if grams > 1:
        parts = " || ' ' || ".join(f"qt[i + {k}]" for k in range(grams))
        q = f"CASE WHEN len(qt) >= {grams} THEN list_transform(range(1, len(qt) - {grams - 2}), lambda i: {parts}) ELSE [] END"
    base = [(n, b) for n, b in _duck_vocab(1) if n not in ("tok", "freq", "vocab")]
    return base + [
        ("side_toks", f"SELECT row_id, 'q' AS side, {q} AS toks FROM rt UNION ALL SELECT row_id, 'a', ans FROM rt"),
        ("tok", "MATERIALIZED (SELECT row_id, side, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM side_toks)"),
        ("freq", "SELECT side, token FROM tok WHERE token <> 'UNKNOWN' GROUP BY side, token HAVING count(*) > 3"),
        ("vocab", "SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY token) AS idx FROM freq"),
    ]


def _index_query(grams: int):
    name = {1: "read_train_index", 2: "read_train_index_bigram", 3: "read_train_index_trigram"}[grams]

    @query(name, D.with_fx("""
SELECT t.row_id, t.side, t.pos, coalesce(v.idx, 0) AS idx
FROM tok t LEFT JOIN vocab v ON v.side = t.side AND v.token = t.token""", "fx_triples", extra=_duck_train_index(grams)))
    def run(spark, d):
        """Training pairs as vocabulary indices, written as text, read back and taken
        apart again: an index for each place of each side."""
        path = scratch_path(spark, name)
        with swept(spark):
            K.write_table(_train_indices(spark, d, grams), path, mode="ignore")
        back = S.read_table(spark, path)
        sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("text")) for side in ("q", "a")]))
        long = back.select("row_id", sides.alias("s")).select("row_id", "s.side", F.posexplode(T.split_joined("s.text")).alias("pos", "idx"))
        return long.select("row_id", "side", (F.col("pos") + 1).cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"))
    return run


for _grams in (1, 2, 3):
    _index_query(_grams)


@query("convert_test_index", D.with_fx("""
SELECT t.row_id, coalesce(q.text, '') AS q, coalesce(a.text, '') AS a FROM trows t
LEFT JOIN (SELECT row_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS text FROM tidx WHERE side = 'q' GROUP BY row_id) q ON q.row_id = t.row_id
LEFT JOIN (SELECT row_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS text FROM tidx WHERE side = 'a' GROUP BY row_id) a ON a.row_id = t.row_id""",
                                       "fx_triples", extra=_duck_vocab(1) + _duck_test_tokens()))
def convert_test_index(spark, d):
    """Test rows as indices of the TRAINING vocabulary, as text."""
    rows = test_rows(spark, d).select("row_id", "q", "a")
    got = FT.as_indices(rows, {"q": "q", "a": "a"}, train_vocab(spark, d, 1))
    return got.select("row_id", FT.sentence_text("q", "index").alias("q"), FT.sentence_text("a", "index").alias("a"))


@query("convert_paraphrases_embedding", D.with_fx(f"""
SELECT w.row_id, w.side, CAST(w.pos - 1 AS INTEGER) AS pos, CAST(k - 1 AS BIGINT) AS dim, round(vec[k], 6) + 0.0 AS value FROM (
  SELECT w.*, coalesce(v.vec, (SELECT vec FROM unk)) AS vec,
         unnest(range(1, len(coalesce(v.vec, (SELECT vec FROM unk))) + 1)) AS k FROM (
    SELECT row_id, side, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM (
      SELECT row_id, unnest(['q1', 'q2']) AS side, unnest([{D.split_ws(D.no_symbol('f[1]'))}, {D.split_ws(D.no_symbol('f[2]'))}]) AS toks
      FROM (SELECT {D.key('conv_id', 'turn')} AS row_id, string_split({D.strip(f"q1 || {_TAB} || q2")}, {_TAB}) AS f
            FROM fx_paraphrases) WHERE len(f) = 2)) w
  LEFT JOIN fx_word_vectors v ON v.token = w.token) w""", "fx_paraphrases", "fx_word_vectors", extra=_DUCK_UNK))
def convert_paraphrases_embedding(spark, d):
    """Paraphrases as sentences of vectors (``v|v v|v``), written once as text
    and read back, in long form."""
    path = scratch_path(spark, "embedded")
    vectors = X.word_vectors(spark, d)
    rows = G.read_paraphrases(X.paraphrase_lines(spark, d), mode="raw_token")
    got = FT.as_vectors(rows, {"q1": "q1", "q2": "q2"}, vectors, P.unknown_of(spark, d, vectors))
    K.write_tsv(got.select("row_id", *[FT.sentence_text(c, "embedding").alias(c) for c in ("q1", "q2")]),
                path, ["row_id", "q1", "q2"], mode="ignore")
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.get("f", i).alias("t")) for i, s in ((1, "q1"), (2, "q2"))]))
    words = f.select(F.get("f", 0).alias("row_id"), sides.alias("s")).select(
        "row_id", "s.side", F.posexplode(T.split_ws("s.t")).alias("pos", "word"))
    long = words.select("row_id", "side", "pos", F.posexplode(T.text_to_vec("word")).alias("dim", "value"))
    return long.select("row_id", "side", "pos", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))
