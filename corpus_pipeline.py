"""The training-data pipeline: quality rules, line dedup, near-duplicate
documents, repeated passages, packing.

Each stage takes what the one before it kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text. ``run`` writes each
stage's rows to the shared folder and reads them again, as a cluster job would.

Empty tables pass through all stages. A null text has no words and goes in the
first stage; a text that line dedup empties stays as an empty document and is
packed as its end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from qaspark.llm.common import materialize, order_id, table


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_chars`` as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and their host's."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"_ord": order_id("doc_id"), "_th": th})
    judged = quality_rules.judge(keyed, keep=("_ord", "_th"))
    # A verdict follows from the text and its host, so rows alike share theirs.
    kept = judged.where("kept").select("_ord", "_th", F.col("source").alias("_host")).distinct()
    return keyed.join(kept, (keyed["_ord"] == kept["_ord"]) & (keyed["_th"] == kept["_th"])
                      & keyed["source"].eqNullSafe(kept["_host"]), "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    return _columns(line_dedup.dedup_lines(docs), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return ngram_join.drop_near_duplicates(docs).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier place holds."""
    return _columns(substring_dedup.dedup_substrings(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack_documents(docs, compact=True).drop("uid")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the near-duplicate, substring and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
