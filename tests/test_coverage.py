import pytest

from qaspark.operators import coverage as C


def test_coverage_overlap_filter(spark):
    toks = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d1", "b"), ("d2", "c")], "dataset string, token string")
    m1 = spark.createDataFrame([("a",), ("c",)], "token string")
    m2 = spark.createDataFrame([("b",), ("c",), ("z",)], "token string")
    rows = {(r["model"], r["dataset"]): r for r in C.coverage(toks, [("m1", m1), ("m2", m2)]).collect()}
    r = rows[("m1", "d1")]
    assert (r["unseen_occ"], r["total_occ"], r["unseen_tok"], r["total_tok"]) == (1, 3, 1, 2)
    assert r["pct_occ"] == pytest.approx(100 / 3)
    r = rows[("m2", "d1")]
    assert (r["unseen_occ"], r["unseen_tok"]) == (2, 1)
    assert rows[("m1", "d2")]["unseen_occ"] == 0

    ov = {(r["metric"], r["model"]): r["value"] for r in C.overlap([("m1", m1), ("m2", m2)]).collect()}
    assert ov == {("total", ""): 4, ("shared", ""): 1, ("missing", "m1"): 2, ("missing", "m2"): 1}

    pairs = spark.createDataFrame([(1, ["a", "x"], ["b"]), (2, ["x"], ["y"]), (3, [], [])],
                                  "id int, qt array<string>, at array<string>")
    cov = spark.createDataFrame([("a",), ("b",)], "token string")
    kept = {r["id"]: r["misses"] for r in C.filter_covered(pairs, ["id"], ["qt", "at"], cov).collect()}
    assert kept == {1: 1, 3: 0}
