"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaspark.session import ship

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
#: A table of fewer files than cores and between these sizes is dealt out after its
#: scan: a row group is read by one task, however many splits Spark plans for it.
SPREAD_MIN_BYTES, SPREAD_MAX_BYTES = 1 << 19, 1 << 30
#: A task of a dealt table gets about so much at most, however few cores there are.
SPREAD_TASK_BYTES = 8 << 20


def spread(df: DataFrame, path: str) -> DataFrame:
    """``df``, a plain scan of ``path``, dealt evenly over the cores or more tasks if its files are
    too few to occupy them. Only file names and sizes are looked at; a large or
    well-split table is never shuffled."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
    cores = spark.sparkContext.defaultParallelism
    if held.getFileCount() >= cores or not SPREAD_MIN_BYTES <= held.getLength() <= SPREAD_MAX_BYTES:
        return df
    return df.repartition(spread_tasks(held.getLength(), cores))


def spread_tasks(size: int, cores: int) -> int:
    """Tasks for a table of ``size`` bytes: one a core, fewer for a small table, more for a large one."""
    return max(min(cores, max(2, size * 4 // SPREAD_MIN_BYTES)), -(-size // SPREAD_TASK_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spread(spark.read.parquet(path), path)
