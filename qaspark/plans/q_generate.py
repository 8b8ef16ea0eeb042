"""Generation and reader queries: triples -> questions, test rows, paraphrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.operators import generate as G
from qaspark.plans import duck as D
from qaspark.plans.catalog import query
from qaspark.sources import fixtures as X

TAB = "chr(9)"


def _duck_templates() -> str:
    rows = []
    for cls, temps in G.TEMPLATE_SETS.items():
        rows += [f"({D.lit(cls)}, {i}, {D.lit(t)})" for i, t in enumerate(temps)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(cls, seq, tpl)"


def _duck_clean_triples() -> tuple[str, str]:
    return ("ct", f"""
        SELECT tid, r_raw, {D.no_symbol('r_raw')} AS r,
               {D.no_symbol("replace(e1, '.e', '')")} AS e1, {D.no_symbol("replace(e2, '.e', '')")} AS e2
        FROM (SELECT tid, {D.rx("replace(rel, '.r', '')", r"'\w", "")} AS r_raw, e1, e2 FROM fx_triples)""")


def _duck_pairs(class_col: str) -> list[tuple[str, str]]:
    return [_duck_clean_triples(), ("tpl", _duck_templates()), ("gen", f"""
        SELECT c.tid, t.seq,
               replace(replace(replace(t.tpl, '{{r}}', c.r), '{{e1}}', c.e1), '{{e2}}', c.e2) AS q,
               c.e1 || '|' || c.r || '|' || c.e2 AS a
        FROM ct c JOIN tpl t ON t.cls = CASE WHEN c.{class_col} LIKE '%-in' THEN 'in'
                                             WHEN c.{class_col} LIKE '%-on' THEN 'on' ELSE 'normal' END""")]


@query("gen_train_pairs_cleaned", D.with_fx("SELECT * FROM gen", "fx_triples", extra=_duck_pairs("r")))
def gen_train_pairs_cleaned(spark, d):
    return G.expand_triples(X.triples(spark, d), class_on="cleaned")


@query("gen_train_pairs_raw", D.with_fx("SELECT * FROM gen", "fx_triples", extra=_duck_pairs("r_raw")))
def gen_train_pairs_raw(spark, d):
    return G.expand_triples(X.triples(spark, d), class_on="raw")


_DUCK_TEST_LINES = [
    ("label_lines", f"""
        SELECT tid AS line_no,
               (CASE WHEN tid % 11 = 0 THEN 'u' WHEN tid % 3 = 0 THEN '1' ELSE '0' END) || {TAB} ||
               'who ' || rel || ' ' || e2 || {TAB} ||
               (CASE WHEN tid % 4 = 0 THEN rel || ' ' || e1 ELSE rel || ' ' || e1 || ' ' || e2 END) AS value
        FROM fx_triples"""),
    ("tq", f"""SELECT q, min(tid) AS lo, max(tid) AS hi FROM (SELECT tid, 'who ' || rel || ' ' || e2 AS q FROM fx_triples)
              WHERE NOT (starts_with(q, 'who 1-urgent') AND ends_with(q, 'NATION_3.e')) GROUP BY q"""),
    ("cluster_lines", f"""SELECT {D.key(0, 'lo')} AS line_no, CAST(lo AS VARCHAR) || {TAB} || q AS value FROM tq
                         UNION ALL SELECT {D.key(1, 'hi')}, CAST(hi AS VARCHAR) || {TAB} || q FROM tq"""),
    ("tl", f"""SELECT line_no AS row_id, f, len(f) AS nf, f[1] AS l, f[2] AS q0,
                      replace(replace(f[3], '.r', ''), '.e', '') AS a0
               FROM (SELECT line_no, string_split({D.strip('value')}, {TAB}) AS f FROM label_lines)"""),
    ("dim", f"""SELECT q0, arg_max(q_id, line_no) AS q_id FROM (
                  SELECT line_no, f[1] AS q_id, f[2] AS q0
                  FROM (SELECT line_no, string_split({D.strip('value')}, {TAB}) AS f FROM cluster_lines)
                  WHERE len(f) = 2) GROUP BY q0"""),
    ("tp", f"""SELECT tl.*, dim.q_id, {D.split_ws('a0')} AS parts FROM tl LEFT JOIN dim ON tl.q0 = dim.q0"""),
    ("tp2", f"""SELECT *, len(parts) AS np,
                  CASE WHEN nf <> 3 THEN 'bad_line' WHEN q_id IS NULL THEN 'unknown_question'
                       WHEN len(parts) NOT IN (2, 3) THEN 'bad_answer' END AS reject FROM tp"""),
]


@query("gen_test_pairs", D.with_fx(f"""
SELECT row_id, CAST(q_id AS BIGINT) AS q_id, {D.no_symbol('q0')} AS q,
       {D.no_symbol('parts[2]')} || '|' || {D.no_symbol('parts[1]')} || '|' ||
       {D.no_symbol("CASE WHEN np = 3 THEN parts[3] ELSE 'PLACEHOLDER' END")} AS a,
       l AS label
FROM tp2 WHERE reject IS NULL""", "fx_triples", extra=_DUCK_TEST_LINES))
def gen_test_pairs(spark, d):
    t = G.test_pairs(X.test_label_lines(spark, d), X.cluster_id_lines(spark, d))
    return t.filter(F.col("reject").isNull()).select(
        "row_id", F.col("q_id").try_cast("bigint").alias("q_id"), "q", "a",
        F.col("label_text").alias("label"))


@query("gen_test_rejects", D.with_fx("SELECT row_id, reject FROM tp2 WHERE reject IS NOT NULL",
                                     "fx_triples", extra=_DUCK_TEST_LINES))
def gen_test_rejects(spark, d):
    t = G.test_pairs(X.test_label_lines(spark, d), X.cluster_id_lines(spark, d))
    return t.filter(F.col("reject").isNotNull()).select("row_id", "reject")


_DUCK_WHOLE = [(n, b.replace("string_split(" + D.strip("value"), "string_split(" + D.strip("replace(replace(value, '.r', ''), '.e', '')"))
                .replace("replace(replace(f[3], '.r', ''), '.e', '') AS a0", "f[3] AS a0") if n == "tl" else b) for n, b in _DUCK_TEST_LINES]


@query("gen_test_whole_line", D.with_fx("SELECT row_id, q0 AS question, coalesce(reject, '') AS reject FROM tp2",
                                        "fx_triples", extra=_DUCK_WHOLE))
def gen_test_whole_line(spark, d):
    """The original reader's form: suffixes stripped from the whole line, so the
    id lookup misses questions that are listed with them."""
    lines = X.test_label_lines(spark, d)
    t = G.test_pairs(lines, X.cluster_id_lines(spark, d), whole_line=True)
    return t.select("row_id", F.col("q_raw").alias("question"), F.coalesce("reject", F.lit("")).alias("reject"))


def _duck_para(prefix: bool) -> str:
    keep = "AND NOT dead" if prefix else ""
    return D.with_fx(f"""
SELECT ql.q_line, r.a_line, {D.clean_question('ql.tokens')} AS q1, {D.clean_question('r.para')} AS q2
FROM ql JOIN res r ON r.lemma1 = ql.lemma
WHERE r.para IS NOT NULL {keep}""", "fx_questions", "fx_alignments", extra=[
        ("qlines", f"""SELECT line_no, question || {TAB} || tokens || {TAB} || pos || {TAB} || lemma AS value
                       FROM fx_questions"""),
        ("alines", f"SELECT line_no, lemma1 || {TAB} || lemma2 || {TAB} || '1-1' AS value FROM fx_alignments"),
        ("ql", f"""SELECT line_no AS q_line, f[2] AS tokens, f[4] AS lemma
                   FROM (SELECT line_no, string_split({D.strip('value')}, {TAB}) AS f FROM qlines) WHERE len(f) = 4"""),
        ("al", f"""SELECT line_no AS a_line, f[1] AS lemma1, f[2] AS lemma2
                   FROM (SELECT line_no, string_split({D.strip('value')}, {TAB}) AS f FROM alines) WHERE len(f) = 3"""),
        ("sent", "SELECT lemma AS lemma2, arg_max(tokens, q_line) AS para FROM ql GROUP BY lemma"),
        ("res", """SELECT al.a_line, al.lemma1, s.para,
                          bool_or(s.para IS NULL) OVER (PARTITION BY al.lemma1 ORDER BY al.a_line
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead
                   FROM al LEFT JOIN sent s ON al.lemma2 = s.lemma2"""),
    ])


@query("gen_paraphrases", _duck_para(False))
def gen_paraphrases(spark, d):
    return G.paraphrases(X.question_lines(spark, d), X.alignment_lines(spark, d), prefix=False)


@query("gen_paraphrases_parity", _duck_para(True))
def gen_paraphrases_parity(spark, d):
    return G.paraphrases(X.question_lines(spark, d), X.alignment_lines(spark, d), prefix=True)


@query("triples_stratified_sample", D.with_fx("""
SELECT DISTINCT * FROM (
  (SELECT * FROM fx_triples WHERE NOT (rel LIKE '%-in.r' OR rel LIKE '%-on.r') ORDER BY tid LIMIT 30000)
  UNION ALL
  (SELECT * FROM fx_triples WHERE rel LIKE '%-in.r' OR rel LIKE '%-on.r' ORDER BY tid LIMIT 60000))""",
                                              "fx_triples"))
def triples_stratified_sample(spark, d):
    return G.stratified_sample(X.triples(spark, d))


@query("rated_union", f"""
SELECT 0 AS src, doc_id AS line_no, CAST(quality AS VARCHAR) || {TAB} || CAST(doc_id AS VARCHAR) AS value
FROM labels WHERE doc_id % 2 = 0 AND quality = 1
UNION ALL
SELECT 1, doc_id, CAST(quality AS VARCHAR) || {TAB} || CAST(doc_id AS VARCHAR)
FROM labels WHERE doc_id % 2 = 1 AND starts_with(CAST(quality AS VARCHAR), '1')""")
def rated_union(spark, d):
    return G.rated_positive(X.rated_lines(spark, d, 0), X.rated_lines(spark, d, 1))


# ---- readers --------------------------------------------------------------

def _duck_train_lines() -> list[tuple[str, str]]:
    return _duck_pairs("r") + [("train_lines", f"""
        SELECT tid * 100 + seq AS line_no, q || {TAB} || a AS value FROM gen
        UNION ALL SELECT tid * 100 + 99, q FROM gen WHERE tid % 13 = 0 AND seq = 0""")]


def _duck_answer_tokens(expr: str) -> str:
    return f"flatten(list_transform(string_split({expr}, '|'), lambda p: {D.split_ws('p')}))"


@query("read_train_pairs", D.with_fx(f"""
SELECT row_id, array_to_string(qg, {TAB}) AS q, array_to_string(ans, ' ') AS a,
       CAST(len(qg) AS BIGINT) AS n_q, CAST(len(ans) AS BIGINT) AS n_a
FROM (SELECT row_id,
             CASE WHEN len(qt) >= 2 THEN list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1])
                  ELSE [] END AS qg, ans
      FROM (SELECT row_id, {D.split_ws(D.tokenize('f[1]'))} AS qt, {_duck_answer_tokens(D.tokenize('f[2]'))} AS ans
            FROM (SELECT line_no AS row_id, string_split({D.strip('value')}, {TAB}) AS f FROM train_lines)
            WHERE len(f) = 2))""", "fx_triples", extra=_duck_train_lines()))
def read_train_pairs(spark, d):
    r = G.read_train(X.train_lines(spark, d), mode="proc_token", grams=2)
    return r.select("row_id", F.array_join("q", "\t").alias("q"), F.array_join("a", " ").alias("a"),
                    F.size("q").cast("long").alias("n_q"), F.size("a").cast("long").alias("n_a"))


@query("read_test_pairs", D.with_fx(f"""
SELECT row_id, TRY_CAST(f[1] AS INTEGER) AS q_id, array_to_string({D.split_ws('f[2]')}, ' ') AS q,
       array_to_string({_duck_answer_tokens('f[3]')}, ' ') AS a, CAST(TRY_CAST(f[4] AS INTEGER) AS DOUBLE) AS label
FROM (SELECT row_id, string_split({D.strip('value')}, {TAB}) AS f FROM (
        SELECT row_id, CAST(q_id AS VARCHAR) || {TAB} || q || {TAB} || a || {TAB} || coalesce(l, '') AS value
        FROM (SELECT row_id, q_id, {D.no_symbol('q0')} AS q,
                     {D.no_symbol('parts[2]')} || '|' || {D.no_symbol('parts[1]')} || '|' ||
                     {D.no_symbol("CASE WHEN np = 3 THEN parts[3] ELSE 'PLACEHOLDER' END")} AS a, l
              FROM tp2 WHERE reject IS NULL)))
WHERE len(f) = 4""", "fx_triples", extra=_DUCK_TEST_LINES))
def read_test_pairs(spark, d):
    t = G.test_pairs(X.test_label_lines(spark, d), X.cluster_id_lines(spark, d)).filter(F.col("reject").isNull())
    lines = t.select(F.col("row_id").alias("line_no"),
                     F.concat_ws("\t", "q_id", "q", "a", F.coalesce("label_text", F.lit(""))).alias("value"))
    r = G.read_test(lines, mode="raw_token")
    return r.select("row_id", "q_id", F.array_join("q", " ").alias("q"), F.array_join("a", " ").alias("a"),
                    F.col("label").cast("double").alias("label"))


@query("read_paraphrases", D.with_fx(f"""
SELECT row_id, array_to_string({D.split_ws(D.tokenize(D.no_symbol('f[1]')))}, ' ') AS q1,
       array_to_string({D.split_ws(D.tokenize(D.no_symbol('f[2]')))}, ' ') AS q2
FROM (SELECT {D.key('conv_id', 'turn')} AS row_id, string_split({D.strip(f"q1 || {TAB} || q2")}, {TAB}) AS f
      FROM fx_paraphrases) WHERE len(f) = 2""", "fx_paraphrases"))
def read_paraphrases(spark, d):
    r = G.read_paraphrases(X.paraphrase_lines(spark, d), mode="proc_token")
    return r.select("row_id", F.array_join("q1", " ").alias("q1"), F.array_join("q2", " ").alias("q2"))
