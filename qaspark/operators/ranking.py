"""Ranking and running totals within key groups, without one task per group.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key group to
one task; a key holding a third of all rows then stalls the job. Here rows
are range-partitioned on ``(key, order)``, so a hot key is spread over many
partitions. Each ``(partition, key)`` chunk is ranked locally (bounded by a
partition), and chunk offsets - only the first and last key of a range
partition can continue across partitions - come from a table with at most
two rows per partition, which is broadcast with that proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.session import materialize

_PID = "_rr_pid"
_ONE = "_rr_all"


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 sums: Sequence[str] = (), rank_col: str = "rank",
                 n_parts: int | None = None) -> DataFrame:
    """Add ``rank_col`` (1-based row number within ``keys`` by ``order``) and,
    for every column ``s`` in ``sums``, ``run_<s>`` = running sum up to and
    including the row. ``order`` must be a total order within a key."""
    keys = list(keys)
    drop_one = False
    if not keys:
        df = df.withColumn(_ONE, F.lit(0))
        keys = [_ONE]
        drop_one = True
    n = _n_parts(df, n_parts)
    key_cols = [F.col(k) for k in keys]
    # Explicit partition count: AQE never coalesces it, so partition ids are
    # ordered by key range; written, they are the same for every reader.
    ranged = materialize(df.repartitionByRange(n, *key_cols, *order).withColumn(_PID, F.spark_partition_id()), "rank")

    w = Window.partitionBy(_PID, *keys).orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_rr_l", F.row_number().over(w))
    for s in sums:
        local = local.withColumn(f"_rr_l_{s}", F.sum(s).over(wr))

    kstruct = F.struct(*key_cols)
    edges = (ranged.groupBy(_PID).agg(F.min(kstruct).alias("lo"), F.max(kstruct).alias("hi"))
             .select(_PID, F.explode(F.array("lo", "hi")).alias("k"))
             .select(_PID, *[F.col("k")[k].alias(k) for k in keys]).distinct())
    chunk = (local.join(F.broadcast(edges), [_PID, *keys])
             .groupBy(_PID, *keys)
             .agg(F.count(F.lit(1)).alias("_rr_c"), *[F.sum(s).alias(f"_rr_s_{s}") for s in sums]))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = chunk.select(_PID, *keys, F.sum("_rr_c").over(before).alias("_rr_oc"),
                        *[F.sum(f"_rr_s_{s}").over(before).alias(f"_rr_o_{s}") for s in sums])
    out = local.join(F.broadcast(offs), [_PID, *keys], "left")
    out = out.withColumn(rank_col, (F.col("_rr_l") + F.coalesce(F.col("_rr_oc"), F.lit(0))).cast("long"))
    for s in sums:
        out = out.withColumn(f"run_{s}", F.col(f"_rr_l_{s}") + F.coalesce(F.col(f"_rr_o_{s}"), F.lit(0)))
    drop = [_PID, "_rr_l", "_rr_oc"] + [f"_rr_l_{s}" for s in sums] + [f"_rr_o_{s}" for s in sums]
    if drop_one:
        drop.append(_ONE)
    return out.drop(*drop)


def dense_rank_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  name: str = "idx", n_parts: int | None = None) -> DataFrame:
    """Number rows 1..n within ``keys`` in ``order`` (rows must be distinct on
    keys+order); a distributed ``zipWithIndex`` in DataFrame form."""
    return running_rank(df, keys, order, rank_col=name, n_parts=n_parts)
