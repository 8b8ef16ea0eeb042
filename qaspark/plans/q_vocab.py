"""Vocabulary queries: index, sizes, token sequences, n-gram counts, data set counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.operators import generate as G
from qaspark.operators import vectors as VEC
from qaspark.operators import vocab as VO
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.plans.q_generate import _DUCK_TEST_LINES, _duck_answer_tokens, _duck_train_lines, TAB
from qaspark.sources import fixtures as X


def train_tokens(spark, d, grams=1):
    r = G.read_train(X.train_lines(spark, d), mode="proc_token", grams=grams)
    return VO.side_tokens(r, {"q": "q", "a": "a"})


def train_sentences(spark, d):
    """Distinct sentences of the training pairs (questions tokenised, answers split on ``|``) with
    their tokens, each normalised once."""
    from qaspark.functions import text as T
    return VO.sentence_tokens(G._fields(X.train_lines(spark, d), 2), {
        "q": ("f0", lambda c: T.split_ws(T.tokenize(c))),
        "a": ("f1", lambda c: T.answer_tokens(T.tokenize(c))),
    })


def train_vocab(spark, d, grams=1, sentences=None):
    """Vocabulary of the training pairs, questions n-grammed. ``sentences``
    (:func:`train_sentences`) shares the normalised sentences between vocabularies."""
    sentences = sentences if sentences is not None else train_sentences(spark, d)
    return VO.build_vocab(VO.weighted_token_counts(sentences, {"q": grams}), counted=True)


def test_rows(spark, d, mode="raw_token"):
    t = G.test_pairs(X.test_label_lines(spark, d), X.cluster_id_lines(spark, d)).filter(F.col("reject").isNull())
    lines = t.select(F.col("row_id").alias("line_no"),
                     F.concat_ws("\t", "q_id", "q", "a", F.coalesce("label_text", F.lit(""))).alias("value"))
    return G.read_test(lines, mode=mode)


def _duck_vocab(grams: int, name: str = "vocab") -> list[tuple[str, str]]:
    qt = "qt"
    if grams > 1:
        parts = " || ' ' || ".join(f"qt[i + {k}]" for k in range(grams))
        qt = (f"CASE WHEN len(qt) >= {grams} THEN list_transform(range(1, len(qt) - {grams - 2}), lambda i: {parts}) "
              "ELSE [] END")
    return _duck_train_lines() + [
        ("rt", f"""SELECT row_id, {D.split_ws(D.tokenize('f[1]'))} AS qt, {_duck_answer_tokens(D.tokenize('f[2]'))} AS ans
                   FROM (SELECT line_no AS row_id, string_split({D.strip('value')}, {TAB}) AS f FROM train_lines)
                   WHERE len(f) = 2"""),
        ("tok", f"SELECT 'q' AS side, unnest({qt}) AS token FROM rt UNION ALL SELECT 'a', unnest(ans) FROM rt"),
        ("freq", "SELECT side, token FROM tok WHERE token <> 'UNKNOWN' GROUP BY side, token HAVING count(*) > 3"),
        (name, """SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY token) AS idx FROM freq
                  UNION ALL SELECT DISTINCT side, 'UNKNOWN', CAST(0 AS BIGINT) FROM freq"""),
    ]


@query("vocab_index", D.with_fx("SELECT side, token, idx FROM vocab", "fx_triples", extra=_duck_vocab(1)))
def vocab_index(spark, d):
    return train_vocab(spark, d, 1)


@query("vocab_index_bigram", D.with_fx("SELECT side, token, idx FROM vocab", "fx_triples", extra=_duck_vocab(2)))
def vocab_index_bigram(spark, d):
    return train_vocab(spark, d, 2)


@query("vocab_index_trigram", D.with_fx("SELECT side, token, idx FROM vocab", "fx_triples", extra=_duck_vocab(3)))
def vocab_index_trigram(spark, d):
    return train_vocab(spark, d, 3)


def _duck_sizes() -> str:
    extra = _duck_vocab(1)
    for n in (2, 3):
        names = {"tok": f"tok{n}", "freq": f"freq{n}", "vocab": f"vocab{n}"}
        for name, body in _duck_vocab(n):
            if name in names:
                extra.append((names[name], body.replace("FROM tok ", f"FROM tok{n} ").replace("FROM freq", f"FROM freq{n}")))
    parts = [f"SELECT {n} AS grams, side, max(idx) + 1 AS n FROM vocab{n if n > 1 else ''} GROUP BY side" for n in (1, 2, 3)]
    return D.with_fx(" UNION ALL ".join(parts), "fx_triples", extra=extra)


@query("vocab_sizes", _duck_sizes())
def vocab_sizes(spark, d):
    out, sentences = None, train_sentences(spark, d)
    for n in (1, 2, 3):
        s = VO.vocab_sizes(train_vocab(spark, d, n, sentences)).select(F.lit(n).alias("grams"), "side", "n")
        out = s if out is None else out.unionByName(s)
    return out


def _duck_test_tokens() -> list[tuple[str, str]]:
    return _DUCK_TEST_LINES + [
        ("tlines", f"""SELECT row_id AS line_no,
               CAST(q_id AS VARCHAR) || {TAB} || {D.no_symbol('q0')} || {TAB} ||
               {D.no_symbol('parts[2]')} || '|' || {D.no_symbol('parts[1]')} || '|' ||
               {D.no_symbol("CASE WHEN np = 3 THEN parts[3] ELSE 'PLACEHOLDER' END")} || {TAB} || coalesce(l, '') AS value
               FROM tp2 WHERE reject IS NULL"""),
        ("trows", f"""SELECT row_id, {D.split_ws('f[2]')} AS qt, {_duck_answer_tokens('f[3]')} AS ans
                      FROM (SELECT line_no AS row_id, string_split({D.strip('value')}, {TAB}) AS f FROM tlines)
                      WHERE len(f) = 4"""),
        ("ttok", """SELECT row_id, 'q' AS side, unnest(qt) AS token, generate_subscripts(qt, 1) - 1 AS pos FROM trows
                    UNION ALL
                    SELECT row_id, 'a', unnest(ans), generate_subscripts(ans, 1) - 1 FROM trows"""),
        ("tidx", """SELECT t.row_id, t.side, t.pos, coalesce(v.idx, 0) AS idx
                    FROM ttok t LEFT JOIN vocab v ON v.side = t.side AND v.token = t.token"""),
    ]


@query("index_sequences", D.with_fx("SELECT row_id, side, CAST(pos AS INTEGER) AS pos, idx FROM tidx",
                                    "fx_triples", extra=_duck_vocab(1) + _duck_test_tokens()))
def index_sequences(spark, d):
    toks = VO.side_tokens(test_rows(spark, d), {"q": "q", "a": "a"})
    return VO.index_tokens(toks, train_vocab(spark, d, 1))


@query("ngram_counts", D.with_fx("SELECT row_id, side, idx, count(*) AS cnt FROM tidx GROUP BY row_id, side, idx",
                                 "fx_triples", extra=_duck_vocab(1) + _duck_test_tokens()))
def ngram_counts(spark, d):
    toks = VO.side_tokens(test_rows(spark, d), {"q": "q", "a": "a"})
    return VO.ngram_counts(VO.index_tokens(toks, train_vocab(spark, d, 1)))


@query("dataset_counts", D.with_fx("""
SELECT 'train_pairs' AS dataset, count(*) AS n FROM train_lines WHERE len(string_split(""" + D.strip("value") + """, chr(9))) = 2
UNION ALL SELECT 'test_pairs', count(*) FROM tp2 WHERE reject IS NULL
UNION ALL SELECT 'paraphrases', count(*) FROM fx_paraphrases
UNION ALL SELECT 'corpus_lines', count(*) FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) FROM documents)
UNION ALL SELECT 'word_vectors', count(*) FROM fx_word_vectors""",
                                   "fx_triples", "fx_paraphrases", "fx_word_vectors",
                                   extra=_duck_train_lines() + _DUCK_TEST_LINES))
def dataset_counts(spark, d):
    def n(name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "n")
    parts = [
        n("train_pairs", G.read_train(X.train_lines(spark, d))),
        n("test_pairs", test_rows(spark, d, "raw")),
        n("paraphrases", X.paraphrase_pairs(spark, d)),
        n("corpus_lines", VEC.corpus_lines(X.corpus(spark, d))),
        n("word_vectors", X.word_vectors(spark, d)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
