"""Session construction and the shared working folder.

Lineage is cut with written tables placed under ``spark.checkpoint.dir``: on
a cluster that folder is shared storage named by the cluster configuration.
Only in local mode, and only when it is unset, do we create one ourselves.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark's own names: the shuffle files of a query go when it ends, not when the driver happens to collect its
#: garbage; and a union of single partitions stays as many partitions.
_CLEANUP, _ONE_PARTITION = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.unionOutputPartitioning"
#: Scratch folders made inside :func:`temporary`, innermost last.
_MADE: list[list[str]] = []


def get_spark(master: str | None = None, app: str = "qaspark",
              shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """A session with our defaults. A submitted master and submitted settings
    stay as they are; ``BENCH_CPUS`` asks for local mode with that many cores."""
    if not master and os.environ.get("BENCH_CPUS"):
        master = f"local[{os.environ['BENCH_CPUS']}]"
    builder = (
        SparkSession.builder
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if is_local(spark) and not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    ship(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context: closures refer to
    its modules, and a worker need not share the driver's working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_qaspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="qaspark-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    atexit.register(os.unlink, path)
    sc._qaspark_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="qaspark-work-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared working folder."""
    ship(spark)  # whoever made the session: what writes here may run our Python
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end: no plan that outlives it may read them."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files: the driver may not collect its garbage for a long time, and
    all shuffles until then would stay on disk."""
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _ONE_PARTITION)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_ONE_PARTITION, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet, in folders by the columns ``by``. Its shuffle files are deleted as soon as it is written."""
    with swept(df.sparkSession):
        w = df.write.mode(mode)
        (w.partitionBy(*by) if by else w).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared working folder
    and read it back: cuts lineage in one job (a reliable ``checkpoint()``
    computes the plan twice unless it is cached) and survives executor loss. Its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)
