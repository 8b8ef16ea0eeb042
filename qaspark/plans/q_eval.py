"""Evaluation queries: statistics record, MAP both orders, reports, prediction file."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.operators import evaluate as E
from qaspark.plans.catalog import query
from qaspark.plans import duck as D
from qaspark.plans.duck import with_fx
from qaspark.sources import fixtures as X
from qaspark.sources.tables import table

_EVAL_FX = ("fx_labels", "fx_preds", "fx_eval_questions")

_P = [("p", """SELECT q, answer, min(line_no) AS first_line, arg_max(dist, line_no) AS dist
               FROM fx_preds GROUP BY q, answer"""),
      ("pl", "SELECT p.*, l.label FROM p LEFT JOIN fx_labels l ON p.q = l.q AND p.answer = l.answer")]

_AT1 = _P + [
    ("best", """SELECT q, label, 1 AS hp FROM (
                  SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY dist, first_line) AS rn FROM pl)
                WHERE rn = 1"""),
    ("anyp", "SELECT q, max(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS any_pos FROM pl GROUP BY q"),
]


def _ap_ctes(direction: str):
    order = "dist ASC, first_line" if direction == "asc" else "dist DESC, first_line"
    return [
        ("ranked", f"""SELECT q, label,
                  row_number() OVER (PARTITION BY q ORDER BY {order}) AS rk,
                  sum(coalesce(label, 0)) OVER (PARTITION BY q ORDER BY {order}
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS corr
                FROM pl"""),
        ("numer", """SELECT q, sum(CASE WHEN label IS NOT NULL THEN CAST(corr AS DOUBLE) / rk * label
                                      ELSE 0 END) AS numer FROM ranked GROUP BY q"""),
        ("denom", "SELECT q, sum(label) AS denom FROM fx_labels GROUP BY q"),
        ("ap", """SELECT n.q, CASE WHEN coalesce(d.denom, 0) = 0 THEN 0.0
                                   ELSE n.numer / d.denom END AS ap
                  FROM numer n LEFT JOIN denom d ON n.q = d.q"""),
    ]


_STATS_BODY = """
SELECT round(correct / nullif(predictions, 0), 6) AS precision_at1,
       round(correct / total, 6) AS recall_at1,
       round(2 * (correct / nullif(predictions, 0)) * (correct / total)
             / nullif(correct / nullif(predictions, 0) + correct / total, 0), 6) AS f1,
       round(n_rank / total, 6) AS ranking_error_rate,
       round(n_lex / total, 6) AS lexicon_error_rate,
       correct, total, predictions, round(map, 6) AS mean_average_precision
FROM (
  SELECT CAST(count(*) AS DOUBLE) AS total,
         CAST(sum(CASE WHEN b.hp = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS predictions,
         CAST(coalesce(sum(CASE WHEN b.hp = 1 THEN b.label END), 0) AS DOUBLE) AS correct,
         CAST(sum(CASE WHEN b.hp = 1 AND b.label = 0 AND a.any_pos = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n_rank,
         CAST(sum(CASE WHEN b.hp IS NULL OR (b.label = 0 AND a.any_pos = 0) THEN 1 ELSE 0 END) AS DOUBLE) AS n_lex,
         avg(coalesce(ap.ap, 0.0)) AS map
  FROM fx_eval_questions e
  LEFT JOIN best b ON e.q = b.q LEFT JOIN anyp a ON e.q = a.q LEFT JOIN ap ON e.q = ap.q)
"""
_STATS_SQL = with_fx(_STATS_BODY, *_EVAL_FX, extra=_AT1 + _ap_ctes("desc"))


def _inputs(spark, d):
    return X.eval_preds(spark, d), X.eval_labels(spark, d), X.eval_questions(spark, d)


def _round(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("eval_stats_at1", _STATS_SQL)
def eval_stats_at1(spark, d):
    s = E.stats(*_inputs(spark, d), direction="desc")
    return _round(s, ["precision_at1", "recall_at1", "f1", "ranking_error_rate",
                      "lexicon_error_rate", "mean_average_precision"])


def _map_sql(direction):
    return with_fx("""
SELECT round(avg(coalesce(ap.ap, 0.0)), 6) AS map, count(*) AS n_questions
FROM fx_eval_questions e LEFT JOIN ap ON e.q = ap.q""", *_EVAL_FX, extra=_P + _ap_ctes(direction))


@query("eval_map_asc", _map_sql("asc"))
def eval_map_asc(spark, d):
    return _round(E.mean_average_precision(*_inputs(spark, d), direction="asc"), ["map"])


@query("eval_map_desc", _map_sql("desc"))
def eval_map_desc(spark, d):
    return _round(E.mean_average_precision(*_inputs(spark, d), direction="desc"), ["map"])


@query("eval_report", with_fx("""
SELECT e.pos, e.q, 'question' AS section, 0 AS rank,
       CAST((SELECT count(*) FROM p WHERE p.q = e.q) AS VARCHAR) AS answer, CAST(NULL AS DOUBLE) AS score, '' AS mark
FROM fx_eval_questions e
UNION ALL
SELECT e.pos, e.q, s.section, s.rank, s.answer, s.score, s.mark
FROM fx_eval_questions e JOIN (
  SELECT q, 'answer' AS section,
         row_number() OVER (PARTITION BY q ORDER BY dist DESC, answer DESC) AS rank,
         answer, round(dist, 6) AS score,
         CASE WHEN coalesce(label, 0) <> 0 THEN ' ' ELSE '*' END AS mark
  FROM pl
  UNION ALL
  SELECT q, 'missed', row_number() OVER (PARTITION BY q ORDER BY answer), answer, CAST(NULL AS DOUBLE), '?'
  FROM fx_labels l
  WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM p WHERE p.q = l.q AND p.answer = l.answer)
) s ON e.q = s.q""", *_EVAL_FX, extra=_P))
def eval_report(spark, d):
    return E.report(*_inputs(spark, d))


@query("eval_report_top", with_fx("""
SELECT e.pos, e.q, t.answer
FROM fx_eval_questions e LEFT JOIN (
  SELECT q, answer FROM (
    SELECT q, answer, row_number() OVER (PARTITION BY q ORDER BY dist DESC, answer DESC) AS rn FROM p)
  WHERE rn = 1) t ON e.q = t.q""", *_EVAL_FX, extra=_P))
def eval_report_top(spark, d):
    return E.report_top(*_inputs(spark, d))


@query("predictions_file_order", with_fx("""
SELECT min(line_no) OVER (PARTITION BY q) AS first_line, line_no, q, round(dist, 6) AS dist, answer
FROM fx_preds""", "fx_preds"))
def predictions_file_order(spark, d):
    out = E.prediction_file(X.eval_preds(spark, d))
    return out.withColumn("dist", F.round("dist", 6))


# Label lines with "u" rows, repeated lines (the last one wins) and a short line;
# prediction lines; question lines.
_FILE_FX = [
    ("label_lines", f"""
        SELECT {D.key(0, 'd.doc_id')} AS line_no,
               (CASE WHEN d.doc_id % 9 = 0 THEN 'u' ELSE CAST(l.quality AS VARCHAR) END) || chr(9) || d.source || '-' ||
               CAST(d.doc_id % 7 AS VARCHAR) || chr(9) || CAST(d.doc_id AS VARCHAR) AS value
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT {D.key(1, 'd.doc_id')}, CAST(1 - l.quality AS VARCHAR) || chr(9) || d.source || '-' ||
               CAST(d.doc_id % 7 AS VARCHAR) || chr(9) || CAST(d.doc_id AS VARCHAR)
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 11 = 0
        UNION ALL SELECT {D.key(2, 0)}, 'short line'"""),
    ("lab", "SELECT line_no, string_split(value, chr(9)) AS f FROM label_lines"),
    ("labels_read", """SELECT f[2] AS q, f[3] AS answer, arg_max(CAST(f[1] AS INTEGER), line_no) AS label
                       FROM lab WHERE len(f) >= 3 AND f[1] <> 'u' GROUP BY ALL"""),
    ("p", """SELECT q, answer, min(line_no) AS first_line, arg_max(dist, line_no) AS dist
             FROM fx_preds GROUP BY q, answer"""),
    ("pl", "SELECT p.*, l.label FROM p LEFT JOIN labels_read l ON p.q = l.q AND p.answer = l.answer"),
]


def _label_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    q, answer = X._doc_q(), F.col("doc_id").cast("string")
    mark = F.when(F.col("doc_id") % 9 == 0, "u").otherwise(F.col("quality").cast("string"))
    first = docs.select(X.line_key(0, F.col("doc_id")).alias("line_no"), F.concat_ws("\t", mark, q, answer).alias("value"))
    last = docs.where(F.col("doc_id") % 11 == 0).select(
        X.line_key(1, F.col("doc_id")).alias("line_no"),
        F.concat_ws("\t", (1 - F.col("quality")).cast("string"), q, answer).alias("value"))
    short = spark.range(1).select(X.line_key(2, 0).alias("line_no"), F.lit("short line").alias("value"))
    return first.unionByName(last).unionByName(short)


def _file_ap():
    ctes = dict(_ap_ctes("desc"))
    return [(k, v.replace("fx_labels", "labels_read")) for k, v in ctes.items()]


@query("eval_from_files", with_fx(_STATS_BODY, "fx_preds", "fx_eval_questions",
                                  extra=_FILE_FX + _AT1[len(_P):] + _file_ap()))
def eval_from_files(spark, d):
    """From label, prediction and question lines to the statistics record."""
    preds = E.read_predictions(E.prediction_lines(X.eval_preds(spark, d)).select("line_no", "value"))
    questions = E.read_questions(X.eval_questions(spark, d).select(F.col("pos").alias("line_no"), F.col("q").alias("value")))
    s = E.stats(preds, E.read_labels(_label_lines(spark, d)), questions, direction="desc")
    return _round(s, ["precision_at1", "recall_at1", "f1", "ranking_error_rate",
                      "lexicon_error_rate", "mean_average_precision"])


@query("prediction_lines", with_fx("""
SELECT min(line_no) OVER (PARTITION BY q) AS first_line, line_no,
       q || chr(9) || CASE WHEN k = 0 THEN '0.0' WHEN k = 1 THEN '0.25' WHEN k = 2 THEN '0.5' ELSE '0.75' END || chr(9) || answer AS value
FROM (SELECT *, CAST(substr(answer, length(answer)) AS INTEGER) % 4 AS k FROM fx_preds)""", "fx_preds"))
def prediction_lines(spark, d):
    """The prediction file: distances set beside the rows by line, then written by question."""
    rows = X.eval_preds(spark, d)
    k = F.substring("answer", -1, 1).cast("int") % 4
    scores = rows.select("line_no", (k / 4.0).alias("dist"))
    lines = rows.select("line_no", F.concat_ws("\t", F.lit("u"), "q", "answer").alias("value"))
    return E.prediction_lines(E.align_lines(scores, lines))
