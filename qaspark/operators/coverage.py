"""Embedding coverage of data sets, vocabulary overlap of embedding models,
and the coverage filter on pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUE - a pair is kept when fewer than this many of its token occurrences are uncovered.
MAX_UNCOVERED = 2


def coverage(tokens: DataFrame, models: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Per model and data set: unseen token occurrences and distinct tokens.

    ``tokens``: ``(dataset, token)`` occurrences. ``models``: ``(name, df)``
    with a ``token`` column. Occurrences are pre-aggregated to distinct
    ``(dataset, token)`` counts before any join."""
    from qaspark.session import materialize
    # Distinct (dataset, token) counts are written once and read by every model pass.
    occ = materialize(tokens.groupBy("dataset", "token").agg(F.count(F.lit(1)).alias("cnt")), "token-occurrences")
    out = None
    for name, m in models:
        hit = m.select("token").distinct().withColumn("hit", F.lit(1))
        j = occ.join(hit, "token", "left")
        miss = F.col("hit").isNull()
        r = j.groupBy("dataset").agg(
            F.sum(F.when(miss, F.col("cnt")).otherwise(0)).alias("unseen_occ"),
            F.sum("cnt").alias("total_occ"),
            F.sum(F.when(miss, 1).otherwise(0)).cast("long").alias("unseen_tok"),
            F.count(F.lit(1)).alias("total_tok"))
        r = r.select(F.lit(name).alias("model"), "dataset", "unseen_occ", "total_occ",
                     (F.col("unseen_occ") * 100.0 / F.col("total_occ")).alias("pct_occ"),
                     "unseen_tok", "total_tok",
                     (F.col("unseen_tok") * 100.0 / F.col("total_tok")).alias("pct_tok"))
        out = r if out is None else out.unionByName(r)
    return out


def overlap(models: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Vocabulary overlap of N models: union size, per-model missing count,
    tokens shared by all - as ``(metric, model, value)`` rows."""
    names = [n for n, _ in models]
    tagged = None
    for name, m in models:
        t = m.select("token").distinct().withColumn("model", F.lit(name))
        tagged = t if tagged is None else tagged.unionByName(t)
    per_token = tagged.groupBy("token").agg(F.collect_set("model").alias("ms"))
    aggs = [F.count(F.lit(1)).alias("total"),
            F.sum(F.when(F.size("ms") == len(names), 1).otherwise(0)).cast("long").alias("shared")]
    aggs += [F.sum(F.when(~F.array_contains("ms", n), 1).otherwise(0)).cast("long").alias(f"m{i}")
             for i, n in enumerate(names)]
    one = per_token.agg(*aggs)
    rows = [F.struct(F.lit("total").alias("metric"), F.lit("").alias("model"), F.col("total").alias("value")),
            F.struct(F.lit("shared").alias("metric"), F.lit("").alias("model"), F.col("shared").alias("value"))]
    rows += [F.struct(F.lit("missing").alias("metric"), F.lit(n).alias("model"), F.col(f"m{i}").alias("value"))
             for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def filter_covered(pairs: DataFrame, ids: Sequence[str], token_cols: Sequence[str], covered: DataFrame,
                   max_uncovered: int = MAX_UNCOVERED) -> DataFrame:
    """Keep pairs with fewer than ``max_uncovered`` uncovered token occurrences
    over all ``token_cols``; original columns kept, plus ``misses``."""
    ids = list(ids)
    words = None
    for c in token_cols:
        w = pairs.select(*ids, F.explode(c).alias("token"))
        words = w if words is None else words.unionByName(w)
    missing = words.join(covered.select("token").distinct(), "token", "left_anti")
    misses = missing.groupBy(*ids).agg(F.count(F.lit(1)).alias("misses"))
    out = pairs.join(misses, ids, "left").withColumn("misses", F.coalesce("misses", F.lit(0)).cast("long"))
    return out.filter(F.col("misses") < max_uncovered)
