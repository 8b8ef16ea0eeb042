"""Ranking evaluation: precision/recall at 1, F1, error rates, MAP, reports.

Inputs
  preds      ``(line_no, q, answer, dist)`` - a later line for the same
             ``(q, answer)`` overwrites the value but keeps the first position.
  labels     ``(q, answer, label)`` (optionally ``line_no``; last one wins);
             rows whose label is NULL (an ``u`` in the label file) are dropped.
  questions  ``(pos, q)`` - the question list, duplicates allowed.

Everything is aggregation or the range-partitioned ranking of
:mod:`qaspark.operators.ranking`; no question group goes to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.operators.ranking import running_rank


# ---- text forms -----------------------------------------------------------

def _parts(lines: DataFrame, n: int) -> DataFrame:
    f = F.split(T.strip(F.col("value")), "\t")
    return lines.select("line_no", f.alias("f")).where(F.size("f") >= n)


def read_labels(lines: DataFrame) -> DataFrame:
    """``label \t question \t answer`` lines -> ``(line_no, q, answer, label)``;
    the label ``u`` (not judged) becomes NULL. Shorter lines are dropped."""
    f = _parts(lines, 3)
    label = F.when(F.get("f", 0) != "u", F.get("f", 0).try_cast("int"))
    return f.select("line_no", F.get("f", 1).alias("q"), F.get("f", 2).alias("answer"), label.alias("label"))


def read_predictions(lines: DataFrame) -> DataFrame:
    """``question \t distance \t answer`` lines -> ``(line_no, q, answer, dist)``."""
    f = _parts(lines, 3)
    return f.select("line_no", F.get("f", 0).alias("q"), F.get("f", 2).alias("answer"),
                    F.get("f", 1).try_cast("double").alias("dist"))


def read_questions(lines: DataFrame) -> DataFrame:
    """One question per line -> ``(pos, q)``; ``pos`` is the line number."""
    return lines.select(F.col("line_no").alias("pos"), T.strip(F.col("value")).alias("q"))


def align_lines(scores: DataFrame, label_lines: DataFrame) -> DataFrame:
    """Distances ``(line_no, dist)`` put beside the label file's rows by line:
    ``(line_no, q, answer, dist)``."""
    return read_labels(label_lines).select("line_no", "q", "answer").join(scores.select("line_no", "dist"), "line_no")


def prediction_lines(scores: DataFrame) -> DataFrame:
    """Lines ``question \t distance \t answer`` grouped by question in order of
    first appearance: ``(first_line, line_no, value)``, sorted by the first two."""
    out = prediction_file(scores)
    value = F.concat_ws("\t", "q", F.col("dist").cast("string"), "answer")
    return out.select("first_line", "line_no", value.alias("value")).orderBy("first_line", "line_no")


# ---- evaluation -----------------------------------------------------------

def last_wins(df: DataFrame, keys: list[str], value_cols: list[str], order: str = "line_no") -> DataFrame:
    """One row per key: values of the last line, position of the first."""
    return df.groupBy(*keys).agg(
        F.min(order).alias("first_line"),
        *[F.max_by(v, order).alias(v) for v in value_cols])


def clean_labels(labels: DataFrame) -> DataFrame:
    lab = labels.filter(F.col("label").isNotNull())
    if "line_no" in lab.columns:
        lab = last_wins(lab, ["q", "answer"], ["label"]).drop("first_line")
    return lab.select("q", "answer", "label")


def scored(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Deduplicated predictions with their label (NULL when unlabelled)."""
    p = last_wins(preds, ["q", "answer"], ["dist"])
    return p.join(clean_labels(labels), ["q", "answer"], "left")


def best_answers(sc: DataFrame) -> DataFrame:
    """Per question: smallest distance, first position on ties; plus whether
    any predicted answer is labelled correct."""
    best = F.min(F.struct("dist", "first_line", "answer", "label"))
    return sc.groupBy("q").agg(
        best.alias("b"),
        F.max(F.when(F.col("label") != 0, 1).otherwise(0)).alias("any_pos"))


def _at1_columns(has_pred: Column, blab: Column, any_pos: Column) -> list[Column]:
    wrong = has_pred & blab.isNotNull() & (blab == 0)
    return [
        F.count(F.lit(1)).cast("double").alias("total"),
        F.sum(F.when(has_pred, 1).otherwise(0)).cast("double").alias("predictions"),
        F.coalesce(F.sum(F.when(has_pred, blab)), F.lit(0)).cast("double").alias("correct"),
        F.sum(F.when(wrong & (any_pos == 1), 1).otherwise(0)).cast("double").alias("n_rank_err"),
        F.sum(F.when(~has_pred | (wrong & (any_pos == 0)), 1).otherwise(0)).cast("double").alias("n_lex_err"),
    ]


def _at1_select() -> list[Column]:
    p = F.try_divide(F.col("correct"), F.col("predictions"))
    r = F.try_divide(F.col("correct"), F.col("total"))
    return [p.alias("precision_at1"), r.alias("recall_at1"),
            F.try_divide(2 * p * r, p + r).alias("f1"),
            F.try_divide(F.col("n_rank_err"), F.col("total")).alias("ranking_error_rate"),
            F.try_divide(F.col("n_lex_err"), F.col("total")).alias("lexicon_error_rate"),
            "correct", "total", "predictions"]


def at1_stats(preds: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    b = best_answers(scored(preds, labels))
    j = questions.join(b, "q", "left")
    agg = j.agg(*_at1_columns(F.col("b").isNotNull(), F.col("b.label"), F.col("any_pos")))
    return agg.select(*_at1_select())


def _rank_order(direction: str) -> list[Column]:
    if direction == "asc":
        return [F.col("dist").asc(), F.col("first_line").asc()]
    if direction == "desc":
        return [F.col("dist").desc(), F.col("first_line").asc()]
    raise ValueError("direction must be 'asc' or 'desc'")


def average_precision(preds: DataFrame, labels: DataFrame, direction: str = "asc") -> DataFrame:
    """``(q, ap)`` for every question with predictions.

    Answers are walked by distance (``asc``, nearest first) or by the reverse
    order the original scorer used (``desc``); unlabelled answers take a rank
    but add no relevance."""
    sc = scored(preds, labels).withColumn("rel", F.coalesce(F.col("label"), F.lit(0)).cast("double"))
    ranked = running_rank(sc, ["q"], _rank_order(direction), sums=["rel"])
    contrib = ranked.groupBy("q").agg(
        F.sum(F.when(F.col("label").isNotNull(), F.col("run_rel") / F.col("rank") * F.col("rel"))
              .otherwise(0.0)).alias("numer"))
    denom = clean_labels(labels).groupBy("q").agg(F.sum("label").cast("double").alias("denom"))
    j = contrib.join(denom, "q", "left")
    ap = F.when(F.coalesce(F.col("denom"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("numer") / F.col("denom"))
    return j.select("q", ap.alias("ap"))


def mean_average_precision(preds: DataFrame, labels: DataFrame, questions: DataFrame,
                           direction: str = "asc") -> DataFrame:
    ap = average_precision(preds, labels, direction)
    return (questions.join(ap, "q", "left")
            .agg(F.avg(F.coalesce(F.col("ap"), F.lit(0.0))).alias("map"),
                 F.count(F.lit(1)).cast("long").alias("n_questions")))


def stats(preds: DataFrame, labels: DataFrame, questions: DataFrame, direction: str = "desc") -> DataFrame:
    """Full statistics record (at-1 numbers and MAP), one row, one aggregation."""
    b = best_answers(scored(preds, labels))
    ap = average_precision(preds, labels, direction)
    j = questions.join(b, "q", "left").join(ap, "q", "left")
    agg = j.agg(*_at1_columns(F.col("b").isNotNull(), F.col("b.label"), F.col("any_pos")),
                F.avg(F.coalesce(F.col("ap"), F.lit(0.0))).alias("mean_average_precision"))
    return agg.select(*_at1_select(), "mean_average_precision")


def report(preds: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """Per listed question: a header row with the number of its answers, the
    answers ranked by score then answer, both descending (``mark`` ' ' = labelled correct, '*' otherwise), followed by
    labelled-correct answers that were never predicted (``mark`` '?')."""
    sc = scored(preds, labels)
    ranked = running_rank(sc, ["q"], [F.col("dist").desc(), F.col("answer").desc()])
    shown = ranked.select(
        "q", F.lit("answer").alias("section"), "rank", "answer",
        F.round("dist", 6).alias("score"),
        F.when(F.coalesce(F.col("label"), F.lit(0)) != 0, F.lit(" ")).otherwise(F.lit("*")).alias("mark"))
    pos = clean_labels(labels).filter(F.col("label") != 0)
    missed = pos.join(sc.select("q", "answer"), ["q", "answer"], "left_anti")
    missed = running_rank(missed, ["q"], [F.col("answer").asc()]).select(
        "q", F.lit("missed").alias("section"), "rank", "answer",
        F.lit(None).cast("double").alias("score"), F.lit("?").alias("mark"))
    # Every listed question is shown, with the number of its answers.
    counts = questions.join(sc.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").select(
        "pos", "q", F.lit("question").alias("section"), F.lit(0).cast("long").alias("rank"),
        F.coalesce("n", F.lit(0)).cast("string").alias("answer"),
        F.lit(None).cast("double").alias("score"), F.lit("").alias("mark"))
    lines = questions.join(shown.unionByName(missed), "q").select("pos", "q", "section", "rank", "answer", "score", "mark")
    return counts.unionByName(lines)


def report_top(preds: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """Top answer per listed question (largest score, then largest answer, as
    the original report ordered), NULL answer for questions without any."""
    p = last_wins(preds, ["q", "answer"], ["dist"])
    top = p.groupBy("q").agg(F.max(F.struct("dist", "answer")).alias("t"))
    return questions.join(top, "q", "left").select("pos", "q", F.col("t.answer").alias("answer"))


def prediction_file(scores: DataFrame) -> DataFrame:
    """Predictions grouped by question in first-appearance order.

    ``scores``: ``(line_no, q, answer, dist)``. Adds ``first_line`` (first line
    of the question); output order is ``(first_line, line_no)``."""
    first = scores.groupBy("q").agg(F.min("line_no").alias("first_line"))
    return scores.join(first, "q").select("first_line", "line_no", "q", "dist", "answer")
