"""Line dedup with levelled sorted runs of line hashes (operator 3).

``LineRuns`` keeps the keys seen so far as sorted runs: tables bucketed and
sorted by the line hash. A new batch is reduced to its distinct keys with
their smallest document id, merge-anti-joined with every run (both sides
are partitioned and sorted alike, so the runs are never shuffled again), and
what is left becomes a run of level 0. When a level holds ``fanout`` runs they
are compacted into one run of the next level.

A line is dropped when its key is long enough and its document is not the
first holder of the key: the occurrences are anti-joined with the runs on
(hash, first document). That join is dealt out by hash AND document, so a line
that a third of all documents share spreads over all tasks.

Defined results: a null or empty text is one empty line; a null id counts as
one last document; rows that share a document id count as one document, whose
lines all stay or all go; an empty table gives an empty table. Two 64-bit
hashes stand for a key. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm.common import SPACES, delete_path, discard, materialize, order_id
from qaspark.session import scratch_path

_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    key = F.btrim(line, F.lit(SPACES))
    # lower() is the same and much faster where all characters are ASCII.
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(
        F.translate(key, string.ascii_uppercase, string.ascii_lowercase))


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_chars: int = 10) -> DataFrame:
    """(ord, th, pos, h1, h2) of every line whose key has ``min_chars`` code
    points or more; ``th`` is a hash of the text, which with the id names the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(order_id(id_col).alias("ord"), F.xxhash64(text).alias("th"),
                        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("ord", "th", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "ord", "th", "pos", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


class LineRuns:
    """Levelled sorted runs (h1, h2, first) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{self.path.rsplit('-', 1)[-1]}_{self._made}"
        self._made += 1
        (keys.select(*_KEY, "first").repartition(self.buckets, *_KEY).write
         .bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name))
        return name

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def all(self) -> DataFrame | None:
        """Every key with its first document."""
        out = None
        for n in self.names():
            out = self.spark.table(n) if out is None else out.unionByName(self.spark.table(n))
        return out

    def add(self, occurrences: DataFrame) -> None:
        """Add the keys of a batch that no run holds yet. Ids of a later batch
        must not be smaller than those of an earlier one."""
        new = (occurrences.groupBy(*_KEY).agg(F.min("ord").alias("first"))
               .repartition(self.buckets, *_KEY))
        for n in self.names():
            new = new.join(self.spark.table(n).hint("merge"), _KEY, "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for n in self.levels[level]:
                t = self.spark.table(n)
                merged = t if merged is None else merged.unionByName(t)
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(merged))
            for n in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def close(self) -> None:
        """Delete the runs."""
        for n in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.levels = []
        delete_path(self.spark, self.path)

    def repeated(self, occurrences: DataFrame) -> DataFrame:
        """The occurrences of keys that an earlier document holds."""
        runs = self.all()
        if runs is None:
            return occurrences
        return occurrences.join(runs.withColumnRenamed("first", "ord"), [*_KEY, "ord"], "left_anti")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = 10, n_batches: int = 4, fanout: int = 3) -> DataFrame:
    """(ord, th, gone) for each row that loses lines; ``gone`` holds line
    positions. The table goes through the runs in ``n_batches`` id ranges."""
    spark = docs.sparkSession
    occ = materialize(line_occurrences(docs, id_col, text_col, min_chars), "line-occ")
    cuts = occ.agg(F.percentile_approx("ord", [i / n_batches for i in range(1, n_batches)], 10000)).first()[0]
    edges = [None, *sorted(set(cuts or [])), None]
    runs = LineRuns(spark, fanout)
    for lo, hi in zip(edges, edges[1:], strict=False):
        batch = occ
        batch = batch if lo is None else batch.where(F.col("ord") > lo)
        runs.add(batch if hi is None else batch.where(F.col("ord") <= hi))
    gone = materialize(runs.repeated(occ).groupBy("ord", "th").agg(F.collect_set("pos").alias("gone")), "repeated")
    runs.close()
    discard(occ)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 10, n_batches: int = 4, fanout: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text without repeated lines, and
    ``n_lines``, ``n_dropped`` (long; they replace columns of those names)."""
    gone = repeated_lines(docs, id_col, text_col, min_chars, n_batches, fanout).select(
        F.col("ord").alias("_ld_ord"), F.col("th").alias("_ld_th"), F.col("gone").alias("_ld_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.withColumns({"_ld_ord": order_id(id_col), "_ld_th": F.xxhash64(text)})
    both = left.join(gone, ["_ld_ord", "_ld_th"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(1), F.size(lines)),
                          F.transform("_ld_gone", lambda i: i + 1))
    kept = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(
        F.transform(stay, lambda i: F.element_at(x, i)), "\n")), 1)
    return (both.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("_ld_gone").isNull(), text).otherwise(kept),
    }).drop("_ld_ord", "_ld_th", "_ld_gone"))
