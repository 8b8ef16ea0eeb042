"""Pair generation: triples -> questions, labelled test rows, paraphrases,
and the line readers of the three data sets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.operators.ranking import running_rank
from qaspark.session import materialize

# ---------------------------------------------------------------------------
# FIXED VALUES - question templates by relation class, and the answer form.
TEMPLATES_NORMAL = [
    "Who {r} {e2}",
    "What {r} {e2}",
    "Who does {e1} {r}",
    "What does {e1} {r}",
    "What is the {r} of {e2}",
    "Who is the {r} of {e2}",
    "What is {r} by {e1}",
    "Who is {e2} 's {r}",
    "What is {e2} 's {r}",
    "Who is {r} by {e1}",
]
TEMPLATES_IN = [
    "When did {e1} {r}",
    "When was {e1} {r}",
    "Where was {e1} {r}",
    "Where did {e1} {r}",
]
TEMPLATES_ON = [
    "When did {e1} {r}",
    "When was {e1} {r}",
]
ANSWER_SEP = "|"
PLACEHOLDER = "PLACEHOLDER"
# ---------------------------------------------------------------------------

TEMPLATE_SETS = {"in": TEMPLATES_IN, "on": TEMPLATES_ON, "normal": TEMPLATES_NORMAL}


def _fill(template: str, slots: dict[str, Column]) -> Column:
    parts = [p for p in re.split(r"(\{r\}|\{e1\}|\{e2\})", template) if p]
    return F.concat(*[slots[p[1:-1]] if p.startswith("{") else F.lit(p) for p in parts])


def clean_triples(triples: DataFrame) -> DataFrame:
    """Suffixes ``.r``/``.e`` removed anywhere, ``'x`` possessive removed from
    the relation, symbols cleaned. Keeps ``r_raw`` (before the symbol clean)."""
    r = F.regexp_replace(F.replace(F.col("rel"), F.lit(".r"), F.lit("")), r"'\w", "")
    return triples.select(
        "tid", r.alias("r_raw"),
        T.no_symbol(r).alias("r"),
        T.no_symbol(F.replace(F.col("e1"), F.lit(".e"), F.lit(""))).alias("e1"),
        T.no_symbol(F.replace(F.col("e2"), F.lit(".e"), F.lit(""))).alias("e2"))


def expand_triples(triples: DataFrame, class_on: str = "cleaned") -> DataFrame:
    """``(tid, rel, e1, e2)`` -> ``(tid, seq, q, a)``: one question per template
    of the relation's class (ends ``-in``: 4, ``-on``: 2, else 10).

    ``class_on='cleaned'`` tests the suffix after the symbol clean, as the
    original pipeline effectively ran (the hyphen is gone by then, so every
    triple takes the 10 general templates); ``'raw'`` tests it before."""
    c = clean_triples(triples)
    probe = F.col("r") if class_on == "cleaned" else F.col("r_raw")
    cls = F.when(probe.endswith("-in"), "in").when(probe.endswith("-on"), "on").otherwise("normal")
    c = c.withColumn("cls", cls)
    n = F.when(F.col("cls") == "in", len(TEMPLATES_IN)).when(F.col("cls") == "on", len(TEMPLATES_ON)) \
         .otherwise(len(TEMPLATES_NORMAL))
    x = c.withColumn("seq", F.explode(F.sequence(F.lit(0), n - 1)))
    slots = {"r": F.col("r"), "e1": F.col("e1"), "e2": F.col("e2")}
    q = None
    for name, temps in TEMPLATE_SETS.items():
        for i, t in enumerate(temps):
            cond = (F.col("cls") == name) & (F.col("seq") == i)
            q = F.when(cond, _fill(t, slots)) if q is None else q.when(cond, _fill(t, slots))
    a = F.concat_ws(ANSWER_SEP, "e1", "r", "e2")
    return x.select("tid", F.col("seq").cast("int").alias("seq"), q.alias("q"), a.alias("a"))


def field(arr: Column, i: int) -> Column:
    """0-based array field, NULL when the array is shorter."""
    return F.try_element_at(arr, F.lit(i + 1))


def split_line(value: Column, sep: str = "\t") -> Column:
    """Strip the line, then split on the separator (no CSV quoting)."""
    return F.split(T.strip(value), sep)


def last_wins_map(df: DataFrame, key: str, value: str, order: str = "line_no") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def test_pairs(label_lines: DataFrame, cluster_lines: DataFrame, whole_line: bool = False) -> DataFrame:
    """Labelled QA rows -> ``(row_id, q_id, q_raw, q, a, label_text, reject)``.

    ``label_lines``: ``(line_no, value)`` with ``label \\t question \\t r e1 [e2]``.
    ``cluster_lines``: ``(line_no, value)`` with ``id \\t question``; a question
    listed twice keeps the last id. ``whole_line=True`` strips ``.r``/``.e``
    from the whole line (question included) before the id lookup, as the
    original reader did; by default only the answer field is stripped.
    Rows that cannot be resolved carry a ``reject`` reason instead of failing."""
    def unsuffix(c):
        return F.replace(F.replace(c, F.lit(".r"), F.lit("")), F.lit(".e"), F.lit(""))

    v = F.col("value")
    f = split_line(unsuffix(v) if whole_line else v)
    rows = label_lines.select(F.col("line_no").alias("row_id"), f.alias("f"))
    rows = rows.select("row_id", F.size("f").alias("nf"), field(F.col("f"), 0).alias("l"), field(F.col("f"), 1).alias("q0"),
                       (field(F.col("f"), 2) if whole_line else unsuffix(field(F.col("f"), 2))).alias("a0"))
    dim = cluster_lines.select("line_no", split_line(F.col("value")).alias("f")).filter(F.size("f") == 2)
    dim = last_wins_map(dim.select("line_no", field(F.col("f"), 0).alias("q_id"), field(F.col("f"), 1).alias("q0")),
                        "q0", "q_id")
    j = rows.join(dim, "q0", "left")
    parts = T.split_ws(F.col("a0"))
    n = F.size(parts)
    r, e1 = field(parts, 0), field(parts, 1)
    e2 = F.when(n == 3, field(parts, 2)).otherwise(F.lit(PLACEHOLDER))
    reject = (F.when(F.col("nf") != 3, "bad_line").when(F.col("q_id").isNull(), "unknown_question")
              .when((n != 2) & (n != 3), "bad_answer"))
    return j.select(
        "row_id", F.col("q_id"), F.col("q0").alias("q_raw"), T.no_symbol(F.col("q0")).alias("q"),
        F.concat_ws(ANSWER_SEP, T.no_symbol(e1), T.no_symbol(r), T.no_symbol(e2)).alias("a"),
        F.col("l").alias("label_text"), reject.alias("reject"))


def paraphrases(question_lines: DataFrame, alignment_lines: DataFrame, prefix: bool = False) -> DataFrame:
    """Paraphrase pairs from a question archive and lemma alignments.

    For each archive line ``question \\t tokens \\t pos \\t lemma`` (lines with
    another field count are skipped), every alignment ``lemma -> lemma2`` in
    file order yields ``(tokens, tokens of the last line whose lemma is
    lemma2)``, both cleaned and capitalised. An unresolved ``lemma2`` is
    skipped; ``prefix=True`` instead drops it and every later alignment of
    that lemma, as the original generator did."""
    ql = question_lines.select("line_no", split_line(F.col("value")).alias("f")).filter(F.size("f") == 4)
    ql = ql.select(F.col("line_no").alias("q_line"), field(F.col("f"), 1).alias("tokens"), field(F.col("f"), 3).alias("lemma"))
    al = alignment_lines.select("line_no", split_line(F.col("value")).alias("f")).filter(F.size("f") == 3)
    al = al.select(F.col("line_no").alias("a_line"), field(F.col("f"), 0).alias("lemma1"), field(F.col("f"), 1).alias("lemma2"))
    sent = last_wins_map(ql.withColumnRenamed("q_line", "line_no"), "lemma", "tokens") \
        .select(F.col("lemma").alias("lemma2"), F.col("tokens").alias("para"))
    resolved = al.join(sent, "lemma2", "left")
    if prefix:
        cut = resolved.groupBy("lemma1").agg(F.min(F.when(F.col("para").isNull(), F.col("a_line"))).alias("cut"))
        resolved = resolved.join(cut, "lemma1").filter(F.col("cut").isNull() | (F.col("a_line") < F.col("cut")))
    resolved = resolved.filter(F.col("para").isNotNull()).select(
        "lemma1", "a_line", T.clean_question(F.col("para")).alias("q2"))
    qs = ql.select("q_line", F.col("lemma").alias("lemma1"), T.clean_question(F.col("tokens")).alias("q1"))
    return qs.join(resolved, "lemma1").select("q_line", "a_line", "q1", "q2")


#: Relative rank error of the sketch that finds the cut of a class is 1 / this.
CUT_ACCURACY = 100_000


def class_cuts(rows: DataFrame, limits: dict[bool, int], order: str = "tid") -> dict[bool, int]:
    """For each class larger than its limit, a value of ``order`` that at least as many
    rows as the limit and only a few more do not exceed: a quantile of a mergeable
    sketch, past the wanted share by twice its error. One pass, two rows."""
    n = {r["_special"]: r["n"] for r in rows.groupBy("_special").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, limits[c] / n[c] + 2 / CUT_ACCURACY) for c in n if n[c] > limits[c]}
    if not share:
        return {}
    picked = rows.agg(*[F.percentile_approx(F.when(F.col("_special") == c, F.col(order)), p, CUT_ACCURACY).alias(str(c))
                        for c, p in share.items()]).first()
    return {c: picked[str(c)] for c in share}


def stratified_sample(triples: DataFrame, n_other: int = 30000, n_special: int = 60000) -> DataFrame:
    """Union (distinct) of the first ``n_other`` triples whose relation ends
    neither ``-in.r`` nor ``-on.r`` and the first ``n_special`` that do. Rows beyond a
    class's cut are dropped where they are read; what is left, little more than the
    limits, is ranked exactly and distributed: no task holds a whole class."""
    special = F.col("rel").like("%-in.r") | F.col("rel").like("%-on.r")
    limits = {True: n_special, False: n_other}
    rows = triples.where(F.col("rel").isNotNull()).withColumn("_special", special)
    for c, cut in class_cuts(rows, limits).items():
        rows = rows.where((F.col("_special") != c) | (F.col("tid") <= cut))
    ranked = running_rank(rows, ["_special"], [F.col("tid")], rank_col="_rank")
    limit = F.when(F.col("_special"), n_special).otherwise(n_other)
    return ranked.where(F.col("_rank") <= limit).drop("_special", "_rank").distinct()


def rated_positive(*line_sets: DataFrame) -> DataFrame:
    """Keep lines rated positive (leading ``1``) and stack the sets."""
    out = None
    for i, ls in enumerate(line_sets):
        k = ls.filter(F.col("value").startswith("1")).select(F.lit(i).alias("src"), "line_no", "value")
        out = k if out is None else out.unionByName(k)
    return out


# ---- readers --------------------------------------------------------------

def represent(c: Column, mode: str, is_answer: bool = False) -> Column:
    """Sentence representation: ``raw`` text, ``raw_token`` / ``proc_token``
    token arrays (answers split on ``|`` first)."""
    if mode == "raw":
        return c
    if mode == "proc_token":
        c = T.tokenize(c)
    elif mode != "raw_token":
        raise ValueError(f"unknown mode {mode}")
    return T.answer_tokens(c) if is_answer else T.split_ws(c)


def with_ngrams(df: DataFrame, col: str, grams: int) -> DataFrame:
    """Replace a token-array column by its n-grams. The tokens are a column of
    their own first, so the n-gram lambda does not recompute them per element."""
    if grams <= 1:
        return df
    return df.withColumn(col, T.ngrams(F.col(col), grams))


def _fields(lines: DataFrame, n: int) -> DataFrame:
    """``(line_no, value)`` -> ``(row_id, f0..f{n-1})`` for lines with exactly n fields."""
    # A filter on the split line would be pushed below it and split every line again.
    whole = F.filter(F.array(split_line(F.col("value"))), lambda f: F.size(f) == n)
    f = lines.select(F.col("line_no").alias("row_id"), F.explode(whole).alias("f"))
    return f.select("row_id", *[field(F.col("f"), i).alias(f"f{i}") for i in range(n)])


def train_fields(lines: DataFrame) -> DataFrame:
    """``(row_id, f0, f1)`` of the lines with exactly two fields, written once."""
    return materialize(_fields(lines, 2), "train-fields")


def read_train(lines: DataFrame | None, mode: str = "raw", grams: int = 1, fields: DataFrame | None = None,
               represented: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> DataFrame:
    """``q \\t a`` lines -> ``(row_id, q, a)``; lines without exactly two fields
    are dropped (the original re-emitted the previous pair). Where texts are normalised,
    each distinct one is, once, and the lines take its tokens by a join. ``fields`` are those of the lines
    (:func:`train_fields`), if they are at hand. ``represented`` turns the distinct texts' tokens into something
    else before the join: it takes and gives, for each side, a table ``(text, mult, <side>)``, ``mult`` being how often the
    text stands there, n-grams not yet formed."""
    if mode == "proc_token":
        f = fields if fields is not None else train_fields(lines)
        texts = {}
        for c, name in (("f0", "q"), ("f1", "a")):
            known = f.groupBy(F.col(c).alias("text")).agg(F.count(F.lit(1)).alias("mult"))
            texts[name] = materialize(known.select("text", "mult", represent(F.col("text"), mode, name == "a").alias(name)), "train-tokens")
        if represented:
            texts = represented(texts)
        for c, name in (("f0", "q"), ("f1", "a")):
            f = f.join(texts[name].select(F.col("text").alias(c), name), c)
        r = f.select("row_id", "q", "a")
        return r if represented else with_ngrams(r, "q", grams)
    f = fields if fields is not None else _fields(lines, 2)
    r = f.select("row_id", represent(F.col("f0"), mode, False).alias("q"),
                 represent(F.col("f1"), mode, True).alias("a"))
    return with_ngrams(r, "q", grams) if mode != "raw" else r


def read_test(lines: DataFrame, mode: str = "raw", grams: int = 1) -> DataFrame:
    """``q_id \\t q \\t a \\t label`` lines -> ``(row_id, q_id, q, a, label)``."""
    f = _fields(lines, 4)
    r = f.select("row_id", F.col("f0").try_cast("int").alias("q_id"),
                 represent(F.col("f1"), mode, False).alias("q"),
                 represent(F.col("f2"), mode, True).alias("a"),
                 F.col("f3").try_cast("int").alias("label"))
    return with_ngrams(r, "q", grams) if mode != "raw" else r


def read_paraphrases(lines: DataFrame, mode: str = "raw_token") -> DataFrame:
    """``q1 \\t q2`` lines -> both sides symbol-cleaned, then represented."""
    f = _fields(lines, 2)
    f = f.select("row_id", T.no_symbol(F.col("f0")).alias("f0"), T.no_symbol(F.col("f1")).alias("f1"))
    return f.select("row_id", represent(F.col("f0"), mode).alias("q1"),
                    represent(F.col("f1"), mode).alias("q2"))
