"""Suffix arrays of a table of strings by the difference-cover algorithm.

A string is (sid, t): a distinct id below 2^61 and an array of symbols of at
least 1. Every string ends in a symbol of its own, smaller than all others, so
all suffixes differ. One level of the algorithm:

1. The triples at positions 1 and 2 modulo 3 are sorted and named by rank.
2. If names repeat, each string becomes the names at 1 modulo 3 followed by
   those at 2 modulo 3, and the level is applied to these strings.
3. The remaining suffixes (0 modulo 3) are compared with their neighbours
   through first symbols and the ranks of sampled suffixes, and all are merged.

Sorting is Spark's: names come from a range-partitioned sort of the distinct
triples, and the merge is a sample sort - a bounded sample of suffixes
splits the order into buckets, each bucket is merged in one task. All suffixes
being different, equal triples or equal strings never overfill a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import materialize

_LOW = 1 << 62
#: Suffixes in a bucket of the merge, and sampled suffixes per bucket border.
BUCKET_ROWS, OVERSAMPLE = 300_000, 24


def number_sorted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct ``rows`` with their place (from 1) in the order of ``keys``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                       .withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    first, rowsets = 1, []
    for r in sizes:  # a row per partition
        rowsets.append((r["part"], first))
        first += r["n"]
    starts = rows.sparkSession.createDataFrame(rowsets, "_p long, _s long")
    return (held.withColumn("_p", part).join(F.broadcast(starts), "_p")
            .withColumn(name, F.col("_s") + (F.col("_m") - F.shiftleft("_p", 33))).drop("_m", "_p", "_s"))


def _at(array: str, i) -> F.Column:
    return F.coalesce(F.get(array, i), F.lit(0))


def _order(x: dict[str, np.ndarray]) -> np.ndarray:
    """Places of the rows in suffix order. ``c``: position modulo 3; ``t0 t1``:
    first symbols; ``r0 r1 r2``: rank of the sampled suffix 0, 1, 2 further on."""
    c = x["c"]
    zero, sampled = np.flatnonzero(c == 0), np.flatnonzero(c != 0)
    sampled = sampled[np.argsort(x["r0"][sampled], kind="stable")]
    zero = zero[np.lexsort((x["r1"][zero], x["t0"][zero]))]
    before = np.arange(len(zero))
    for other, keys in ((1, ("r1", "t0")), (2, ("r2", "t1", "t0"))):
        part = np.flatnonzero(c == other)
        both = np.concatenate((part, zero))
        order = np.lexsort([x[k][both] for k in keys])
        is_part = order < len(part)
        passed = np.cumsum(is_part)
        less = np.empty(len(zero), np.int64)
        less[order[~is_part] - len(part)] = passed[~is_part]
        before = before + less
    out = np.empty(len(c), np.int64)
    free = np.ones(len(c), bool)
    out[before] = zero
    free[before] = False
    out[free] = sampled
    return out


_KEYS = ["c", "t0", "t1", "r0", "r1", "r2"]


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {k: pdf[k].to_numpy(np.int64) for k in _KEYS}


def _merge(strings: DataFrame, sampled: DataFrame, width: int = 0) -> DataFrame:
    """(sid, pos, rank) of all suffixes from the ranks of the sampled ones; with
    ``width`` also ``twin``: whether a neighbour has the same first symbols."""
    ranks = sampled.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("rs"))
    flat = (strings.join(ranks, "sid", "left")
            .withColumn("rs", F.transform("rs", lambda x: x["rank"]))
            .select("sid", "t", "rs", F.posexplode("t").alias("pos", "t0")))

    def rank_at(i: F.Column) -> F.Column:  # the sampled positions are 1 2 4 5 7 8 ...
        place = i - 1 - F.floor(i / 3).cast("int")
        return F.when(i % 3 == 0, 0).otherwise(_at("rs", place))

    p = F.col("pos")
    cols = [(p % 3).alias("c"), "t0", _at("t", p + 1).alias("t1"), rank_at(p).alias("r0"),
            rank_at(p + 1).alias("r1"), rank_at(p + 2).alias("r2")]
    if width:
        cols.append(F.slice("t", p + 1, width).alias("w"))
    rows = materialize(flat.select("sid", "pos", *cols), "suffixes")

    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    sample = rows.select(*_KEYS).orderBy(F.xxhash64("sid", "pos")).limit(buckets * OVERSAMPLE).toPandas()
    marks = _columns(sample)
    picked = _order(marks)[OVERSAMPLE::OVERSAMPLE][:buckets - 1]
    marks = {k: v[picked] for k, v in marks.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _columns(b)
            order = _order({k: np.concatenate((x[k], marks[k])) for k in _KEYS})
            is_mark = order >= len(b)
            bucket = np.empty(len(b), np.int32)
            bucket[order[~is_mark]] = np.cumsum(is_mark)[~is_mark]
            yield b.assign(bucket=bucket)

    kind = "sid long, pos int, c int, t0 long, t1 long, r0 long, r1 long, r2 long" + ", w array<long>" * bool(width)
    dealt = rows.mapInPandas(place, kind + ", bucket int")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[_order(_columns(pdf))].reset_index(drop=True)
        out = pd.DataFrame({"bucket": key[0], "sid": pdf["sid"], "pos": pdf["pos"], "k": np.arange(len(pdf))})
        if width:
            full = pdf["w"].map(len).to_numpy() == width
            same = np.zeros(len(pdf) + 1, bool)
            w = np.zeros((len(pdf), width), np.int64)
            if full.any():
                w[full] = np.stack(pdf["w"][full].to_numpy())
            same[1:-1] = (w[1:] == w[:-1]).all(axis=1) & full[1:] & full[:-1]
            out["twin"] = same[1:] | same[:-1]
            # First and last of a bucket are compared with the next bucket's.
            edge = np.zeros(len(pdf), bool)
            edge[[0, -1]] = True
            out["w"] = [x if e and f else None for x, e, f in zip(pdf["w"], edge, full, strict=True)]
        return out

    done = materialize(dealt.groupBy("bucket").applyInPandas(
        merge, "bucket int, sid long, pos int, k long" + ", twin boolean, w array<long>" * bool(width)), "merged")
    sizes = done.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()
    spark, first, starts, ends = rows.sparkSession, 1, [], []
    for r in sizes:  # a row per bucket
        starts.append((r["bucket"], first))
        ends += [(r["bucket"], 0), (r["bucket"], r["n"] - 1)]
        first += r["n"]
    out = (done.join(F.broadcast(spark.createDataFrame(starts, "bucket int, s long")), "bucket")
           .withColumn("rank", F.col("s") + F.col("k")))
    if not width:
        return out.select("sid", "pos", "rank")
    edges = {(r["bucket"], r["k"]): r["w"] for r in done.where(F.col("w").isNotNull()).select("bucket", "k", "w").collect()}
    fixed = []  # two rows per bucket
    for a, b in zip(ends[1::2], ends[2::2], strict=False):
        if edges.get(a) is not None and edges.get(a) == edges.get(b):
            fixed += [a, b]
    fix = spark.createDataFrame(sorted(set(fixed)), "bucket int, k long").withColumn("also", F.lit(True))
    return (out.join(F.broadcast(fix), ["bucket", "k"], "left")
            .select("sid", "pos", "rank", (F.col("twin") | F.coalesce("also", F.lit(False))).alias("twin")))


def _level(strings: DataFrame, width: int = 0) -> DataFrame:
    """Suffix ranks of strings whose last symbols are unlike all others."""
    places = strings.select("sid", "t", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("pos"))
    p = F.col("pos")
    triples = materialize(places.where(p % 3 != 0).select(
        "sid", "pos", F.get("t", p).alias("x"), _at("t", p + 1).alias("y"), _at("t", p + 2).alias("z")), "triples")
    total = triples.count()
    names = materialize(number_sorted(triples.select("x", "y", "z").distinct(), ["x", "y", "z"], "rank"), "names")
    named = materialize(triples.join(names, ["x", "y", "z"]).select("sid", "pos", "rank"), "named")
    if names.count() < total:
        shorter = named.groupBy("sid").agg(F.transform(
            F.sort_array(F.collect_list(F.struct((F.col("pos") % 3).alias("c"), "pos", "rank"))),
            lambda x: x["rank"]).alias("t"), F.sum((F.col("pos") % 3 == 1).cast("int")).alias("ones"))
        shorter = materialize(shorter, "reduced")
        ranks = _level(shorter.select("sid", "t")).join(shorter.select("sid", "ones"), "sid")
        j, ones = F.col("pos"), F.col("ones")
        named = ranks.select("sid", F.when(j < ones, 3 * j + 1).otherwise(3 * (j - ones) + 2).alias("pos"), "rank")
    return _merge(strings, named, width)


def suffix_ranks(strings: DataFrame, width: int = 0) -> DataFrame:
    """(sid, pos, rank) of every suffix of every string (sid, t), rank from 1;
    equal suffixes are ordered by sid. With ``width``, ``twin`` tells whether the
    suffix before or after it in this order begins with the same ``width``
    symbols, that is, whether these symbols also start anywhere else."""
    ended = strings.select("sid", F.concat("t", F.array(F.col("sid") - F.lit(_LOW))).alias("t"))
    return (_level(materialize(ended, "strings"), width)
            .join(strings.select("sid", F.size("t").alias("n")), "sid").where(F.col("pos") < F.col("n")).drop("n"))
