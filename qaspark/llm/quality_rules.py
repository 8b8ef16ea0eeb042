"""Host-level quality rules (operator 2).

Every document is measured by rules on its own text. The failures of each rule
are counted by host, and each host's failure rate is shrunk towards the rate
of all hosts by a beta prior whose two parameters come from the hosts
themselves (method of moments). The verdicts go back to the documents: in a
host whose shrunk rate of any rule reaches ``host_rate`` a document stays only
if it passes every rule; elsewhere it stays unless it fails the base rules.
So a document that breaks no rule never falls because of its host.

Defined results: a null or empty text has no words and fails the base rules; a
null host takes no part in the host counts and has no verdict; an empty
table gives an empty table; rows that repeat count as often as they occur.
Only DataFrame functions are used. The measures are written once, narrow,
because both the host counts and the result need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import let, materialize, words_of

#: Rejected hosts that may be sent to every task; beyond, the join is salted.
BROADCAST_HOSTS, SALTS = 50_000, 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rules on one document; ``base`` alone removes a document.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Windows are
    compared by a 64-bit hash, sorted with their place, neighbours compared."""
    keyed = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(
        F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"),
        i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        return F.transform(
            F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        let(F.array_sort(keyed), lambda s: let(places(s), covered))).cast("long")


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the measures of every text (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(F.col(text_col))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    lines = let(full_lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    wide = docs.select(*keep, row.alias("_qr_w"), lines.alias("_qr_l"), symbols.alias("n_symbols"))
    return wide.select(*keep, "_qr_w.*", "_qr_l.*", "n_symbols")


def host_rates(measured: DataFrame, host_col: str) -> DataFrame:
    """host, n_docs and the shrunk failure rate of each rule.

    Prior by moments over hosts with rates p_h of n_h documents: mean m,
    variance v less the binomial part; alpha + beta = m(1-m)/v - 1, held
    between 1 and 10^6 (no spread between hosts: all shrink to the mean)."""
    fails = [F.sum(F.expr(f"CAST(({r}) AS INT)")).alias(f"f_{k}") for k, r in RULES.items()]
    hosts = materialize(measured.where(F.col(host_col).isNotNull())
                        .groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), *fails), "host-counts")
    stats = []
    for k in RULES:
        p = F.col(f"f_{k}") / F.col("n_docs")
        stats += [(F.sum(f"f_{k}") / F.sum("n_docs")).alias(f"m_{k}"), F.var_pop(p).alias(f"v_{k}")]
    prior = hosts.agg(*stats, F.avg(1 / F.col("n_docs")).alias("inv")).first()  # one row
    rates = hosts
    for k in RULES:
        m = prior[f"m_{k}"] or 0.0
        spread = m * (1 - m)
        v = max((prior[f"v_{k}"] or 0.0) - spread * (prior["inv"] or 0.0), 1e-12)
        weight = min(max(spread / v - 1, 1.0), 1e6)
        rates = rates.withColumn(f"rate_{k}", (F.col(f"f_{k}") + m * weight) / (F.col("n_docs") + weight))
    return rates.select(host_col, "n_docs", *[f"rate_{k}" for k in RULES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", host_rate: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, host, ``keep``, the measures, ``base_failed``, ``host_bad``, ``kept``."""
    cols = tuple(dict.fromkeys((id_col, host_col, *keep)))
    m = materialize(measure(docs, text_col, cols), "quality")
    bad = F.lit(False)
    for k in RULES:
        bad = bad | (F.col(f"rate_{k}") >= host_rate)
    hosts = materialize(host_rates(m, host_col).where(bad).select(host_col, F.lit(True).alias("host_bad")), "hosts")
    any_rule = F.expr(" OR ".join(f"({r})" for r in RULES.values()))
    if hosts.count() <= BROADCAST_HOSTS:
        joined = m.join(F.broadcast(hosts), host_col, "left")
    else:  # a host's documents are dealt over SALTS tasks
        salted = hosts.withColumn("_qr_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = (m.withColumn("_qr_salt", F.pmod(F.xxhash64(*m.columns), F.lit(SALTS)).cast("int"))
                  .join(salted, [host_col, "_qr_salt"], "left").drop("_qr_salt"))
    return (joined
            .withColumn("host_bad", F.coalesce("host_bad", F.lit(False)))
            .withColumn("base_failed", F.expr(RULES["base"]))
            .withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & any_rule)))
