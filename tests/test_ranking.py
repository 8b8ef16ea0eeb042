from pyspark.sql import Window
from pyspark.sql import functions as F

from qaspark.operators.ranking import running_rank


def test_running_rank_matches_window_under_skew(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 37).cast("string")).alias("k"),
        "id", (F.col("id") % 5).alias("v"))
    r = running_rank(df, ["k"], [F.col("v").desc(), F.col("id")], sums=["v"])
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id"))
    ref = df.withColumn("r2", F.row_number().over(w)).withColumn(
        "s2", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = r.join(ref, ["k", "id"])
    assert j.count() == 20000
    assert j.filter((F.col("rank") != F.col("r2")) | (F.col("run_v") != F.col("s2"))).count() == 0


def test_ranks_with_payload_ties_and_many_splits(spark):
    """Large enough that range boundaries are sampled, with columns that the
    ranking itself does not use: every step must see the same split."""
    n = 200_000
    df = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.xxhash64("id") % 997).cast("string")).alias("k"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 50.0).alias("dist"), "id",
        F.concat(F.lit("payload-"), F.sha2(F.col("id").cast("string"), 256)).alias("payload"),
        (F.col("id") % 2).alias("rel"))
    r = running_rank(df, ["k"], [F.col("dist").asc(), F.col("id").asc()], sums=["rel"], n_parts=16)
    w = Window.partitionBy("k").orderBy("dist", "id")
    ref = df.select("k", "id", F.row_number().over(w).alias("r2"),
                    F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s2"))
    j = r.join(ref, ["k", "id"])
    assert j.count() == n
    assert j.filter((F.col("rank") != F.col("r2")) | (F.col("run_rel") != F.col("s2"))).count() == 0
    assert set(r.columns) == {"k", "dist", "id", "payload", "rel", "rank", "run_rel"}


def test_global_numbering(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("x"))
    r = running_rank(df, [], [F.col("x")])
    assert r.filter(F.col("rank") != F.col("x") + 1).count() == 0
