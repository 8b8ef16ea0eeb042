from qaspark.operators import generate as G


def test_sample_with_biting_limits(spark):
    rows = [(i * 3, ("born-in.r", "call-on.r", "be.r")[i % 3], f"e{i}", "x") for i in range(900)] + [(5000 + i, None, "e", "x") for i in range(3)]
    t = spark.createDataFrame(rows, "tid long, rel string, e1 string, e2 string").repartition(4)
    got = G.stratified_sample(t, 40, 70).collect()
    other = sorted(r[0] for r in rows if r[1] == "be.r")[:40]
    special = sorted(r[0] for r in rows if r[1] not in ("be.r", None))[:70]
    assert sorted(r["tid"] for r in got) == sorted(other + special)
    assert G.stratified_sample(t, 10_000, 10_000).count() == 900  # a null relation is like neither kind
    assert G.stratified_sample(t.where("tid < 0"), 5, 5).count() == 0


def test_few_rows_are_left_to_rank(spark):
    t = spark.range(200_000).selectExpr("id AS tid", "id % 4 = 0 AS _special")
    cuts = G.class_cuts(t, {True: 500, False: 60})
    left = {c: t.where(f"_special = {c} AND tid <= {cut}").count() for c, cut in cuts.items()}
    assert 500 <= left[True] <= 500 + 3 * 50_000 / G.CUT_ACCURACY + 1
    assert 60 <= left[False] <= 60 + 3 * 150_000 / G.CUT_ACCURACY + 1
    assert G.class_cuts(t, {True: 10 ** 9, False: 10 ** 9}) == {}
