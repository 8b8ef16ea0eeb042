"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qaspark.session import scratch_path, ship

#: White space of the word and line rules: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that Python code holds at a time.
SLICE_ROWS = 512
#: Documents without an id sort behind all others and count as one document.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_id(id_col: str) -> Column:
    """The document id as a long; null ids become ``NO_ID``."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the decimal id modulo ``m``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def fold_is(id_col: str, m: int, r: int) -> Column:
    """True where the id's fold of ``m`` is ``r``; a null id is in no such fold."""
    return F.coalesce(crc_mod(id_col, m) == r, F.lit(False))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. The job's shuffle
    files are dropped when it ends: nothing reads them again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for t in tables:
        delete_path(t.sparkSession, t._scratch)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_slices(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str,
               rows: int = SLICE_ROWS) -> DataFrame:
    """Like ``mapInPandas``, but ``fn`` sees an Arrow batch in slices of ``rows``
    rows: long texts become Python strings a few at a time. Integer columns with
    nulls hold Python integers and None."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, rows).to_pandas(integer_object_nulls=True)
                  for b in batches for at in range(0, b.num_rows, rows))
        for frame in fn(slices):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, out)


def add_columns(df: DataFrame, inputs: list[str], fn: Callable[..., pd.DataFrame], schema: str,
                rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of the ``inputs``, in slices of
    ``rows`` rows; they replace columns of those names. All others pass as they are."""
    new = StructType.fromDDL(schema)
    keep = [f for f in df.schema.fields if f.name not in new.names]
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                made = fn(*[s.column(c).to_pandas(integer_object_nulls=True) for c in inputs])
                made = pa.RecordBatch.from_pandas(made, schema=arrow, preserve_index=False)
                fields = [s.schema.field(f.name) for f in keep] + list(arrow)
                yield pa.RecordBatch.from_arrays([s.column(f.name) for f in keep] + made.columns, schema=pa.schema(fields))

    return df.mapInArrow(run, StructType(keep + new.fields))
