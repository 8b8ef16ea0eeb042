import numpy as np

from qaspark.operators import neighbors as NB


def test_blocked_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i:03d}", int(i % 3 if i % 4 else 0), rng.normal(size=6).tolist()) for i in range(240)]
    m = spark.createDataFrame(rows, "token string, label int, vec array<double>")
    q = m.selectExpr("token AS qtoken", "label", "vec AS qvec")
    got = NB.topk_in_group(q, m, k=5, block=16, qblock=8).collect()
    got = {(r["qtoken"], r["rank"]): r["token"] for r in got}
    for tok, lab, v in rows:
        cands = []
        for t2, l2, v2 in rows:
            if l2 != lab or t2 == tok:
                continue
            d = 1 - np.dot(v, v2) / (np.linalg.norm(v) * np.linalg.norm(v2))
            cands.append((round(d, 6), t2))
        for rank, (_, t2) in enumerate(sorted(cands)[:5], start=1):
            assert got[(tok, rank)] == t2


def test_nearest_centroid(spark):
    v = spark.createDataFrame([("a", [0.0, 0.1]), ("b", [5.0, 5.2])], "token string, vec array<double>")
    c = spark.createDataFrame([(7, [0.0, 0.0]), (3, [5.0, 5.0])], "label int, vec array<double>")
    assert {r["token"]: r["label"] for r in NB.assign_nearest(v, c).collect()} == {"a": 7, "b": 3}


def test_nearest_centroid_in_one_table_and_in_blocks(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    c[7], x[0] = c[3], c[3]  # equal centroids: the lower label
    v = spark.createDataFrame([(f"t{i}", r.tolist()) for i, r in enumerate(x)], "token string, vec array<double>")
    m = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "label int, vec array<double>")
    want = {f"t{i}": int(np.round(np.sqrt(((c - r) ** 2).sum(axis=1)), 9).argmin()) for i, r in enumerate(x)}
    assert {r["token"]: r["label"] for r in NB.assign_nearest(v, m).collect()} == want
    before = NB.CENTROID_BYTES, NB.BLOCK_BYTES
    NB.CENTROID_BYTES, NB.BLOCK_BYTES = 0, 64 * 40
    try:
        assert {r["token"]: r["label"] for r in NB.assign_nearest(v, m).collect()} == want
    finally:
        NB.CENTROID_BYTES, NB.BLOCK_BYTES = before


def test_expansion_adds_the_unknown_row(spark):
    main = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<double>")
    other = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("c", [1.0, 0.2])], "token string, vec array<double>")
    cents = spark.createDataFrame([(0, [0.5, 0.5])], "label int, vec array<double>")
    labels = NB.assign_nearest(other, cents)
    out = NB.expand_vocabulary(main.select("token").union(other.select("token")), main, other, labels, unknown=[9.0, 9.0])
    got = {r["token"]: (r["how"], r["source"], r["vec"]) for r in out.collect()}
    assert got == {"a": ("direct", "a", [1.0, 0.0]), "b": ("direct", "b", [0.0, 1.0]),
                   "c": ("expanded", "a", [1.0, 0.0]), "UNKNOWN": ("unknown", None, [9.0, 9.0])}
