"""Writers for pairs, feature matrices, models, vocabularies and vectors.

All writers overwrite by default (the original appended, duplicating output
on a second run); ``mode='append'`` or ``'ignore'`` (skip when the target
exists) are available.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions import text as T

# Rows per written feature-matrix file.
SEGMENT_ROWS = 200_000


def write_tsv(df: DataFrame, path: str, cols: Sequence[str], mode: str = "overwrite",
              order: Sequence[str] | None = None) -> None:
    """Tab-separated lines; ``order`` sorts globally first (range partitioned)."""
    out = df
    if order:
        out = out.orderBy(*order)
    out.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value")) \
        .write.mode(mode).text(path)


def write_segments(df: DataFrame, path: str, rows_per_file: int = SEGMENT_ROWS, mode: str = "overwrite") -> None:
    """Feature matrix as Parquet files of at most ``rows_per_file`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Models, vocabularies, vector tables, sparse long-form matrices."""
    df.write.mode(mode).parquet(path)


def write_vectors_text(df: DataFrame, path: str, mode: str = "overwrite", sep: str = "|") -> None:
    """``token \\t v1|v2|...`` lines."""
    df.select(F.concat_ws("\t", "token", T.vec_to_text("vec", sep)).alias("value")).write.mode(mode).text(path)


def write_word2vec_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Word-vector text format: header ``count width``, then ``token v1 v2 ...``.
    The header gets the smallest sort key so it is the first line of the first file."""
    head = df.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"),
                              F.max(F.size("vec")).cast("string")).alias("value")) \
        .select(F.lit(0).alias("k"), F.lit("").alias("token"), "value")
    body = df.select(F.lit(1).alias("k"), "token",
                     F.concat_ws(" ", "token", T.vec_to_text("vec", " ")).alias("value"))
    head.unionByName(body).orderBy("k", "token").select("value").write.mode(mode).text(path)
