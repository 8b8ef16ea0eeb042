"""Readers for text files: TSV lines with their file order, word-vector text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions import text as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a ``line_no`` that follows file order: (file, block
    start, position in the task) - no single-task numbering pass."""
    df = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    return df.select(F.struct("_f", "_b", "_i").alias("line_no"), "value")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A file or directory of corpus files, a sentence per line, as
    symbol-cleaned token arrays ``(line_no, tokens)``."""
    return read_lines(spark, path).select("line_no", T.split_ws(T.no_symbol(F.col("value"))).alias("tokens"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """``(token, vec)`` from the word-vector text format; the header
    ``count width`` line (two fields) is skipped."""
    lines = spark.read.text(path).select(T.split_ws(F.col("value")).alias("f"))
    body = lines.filter(F.size("f") > 2)
    return body.select(F.element_at("f", 1).alias("token"),
                       F.transform(F.slice("f", 2, 1 << 30), lambda x: x.cast("double")).alias("vec"))


def read_vectors_text(spark: SparkSession, path: str, sep: str = r"\|") -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return parts.select(F.element_at("f", 1).alias("token"), T.text_to_vec(F.element_at("f", 2), sep).alias("vec"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
