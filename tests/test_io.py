from pyspark.sql import functions as F

from qaspark.session import materialize, scratch_path
from qaspark.sinks import files as K
from qaspark.sources import files as S


def test_read_lines_keeps_file_order(spark):
    path = scratch_path(spark, "lines")
    df = spark.range(2000).select(F.format_string("line-%05d", "id").alias("v"))
    K.write_tsv(df, path, ["v"], order=["v"])
    back = S.read_lines(spark, path).orderBy("line_no").select("value").collect()
    assert [r["value"] for r in back] == [f"line-{i:05d}" for i in range(2000)]


def test_word2vec_text_roundtrip_and_materialize(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "token string, vec array<double>")
    path = scratch_path(spark, "w2v")
    K.write_word2vec_text(v, path)
    assert spark.read.text(path).orderBy(F.monotonically_increasing_id()).first()["value"] == "2 2"
    back = {r["token"]: r["vec"] for r in S.read_word2vec_text(spark, path).collect()}
    assert back == {"a": [1.0, 2.0], "b": [0.5, -1.0]}
    m = materialize(v, "mat")
    assert sorted(r["token"] for r in m.collect()) == ["a", "b"]
