import numpy as np

from qaspark.operators import neighbors as NB
from qaspark.operators import pivots as PV

SCHEMA = "token string, label int, vec array<double>"


def _brute(rows, queries, k):
    out = {}
    for qt, ql, qv in queries:
        near = sorted((round(1 - float(np.dot(qv, v)) / (np.linalg.norm(qv) * np.linalg.norm(v)), 6), t)
                      for t, lab, v in rows if lab == ql and t != qt and np.linalg.norm(v) > 0) if np.linalg.norm(qv) else []
        out[qt] = [t for _, t in near[:k]]
    return out


def _found(search):
    out = {}
    for r in search.rows.orderBy("qtoken", "rank").collect():
        out.setdefault(r["qtoken"], []).append(r["token"])
    return out


def test_equal_to_brute_force_and_cells_are_skipped(spark):
    rng = np.random.default_rng(5)
    mids = rng.normal(size=(12, 8)) * 6
    rows = [(f"t{i:04d}", 0 if i % 3 else 1, (mids[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(720)]
    rows += [(f"copy{i}", 0, rows[1][2]) for i in range(40)]  # ties: more equals than k
    rows += [("zero", 0, [0.0] * 8), ("lone", 9, [1.0] + [0.0] * 7)]
    m = spark.createDataFrame(rows, SCHEMA)
    s = PV.topk_pruned(m.selectExpr("token AS qtoken", "label", "vec AS qvec"), m, k=5, cell_rows=24)
    want = {t: near for t, near in _brute(rows, rows, 5).items() if near}
    assert _found(s) == want
    v = s.visited().first()
    assert v["cells_visited"] < 0.6 * v["cell_pairs"] and v["members_visited"] < 0.6 * v["member_pairs"]


def test_evenly_spread_vectors_lose_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(f"t{i:03d}", 0, rng.normal(size=4).tolist()) for i in range(200)]
    m = spark.createDataFrame(rows, SCHEMA)
    q = m.where("token < 't050'").selectExpr("token AS qtoken", "label", "vec AS qvec")
    s = PV.topk_pruned(q, m, k=7, cell_rows=10)
    assert _found(s) == _brute(rows, rows[:50], 7)
    assert s.rows.orderBy("qtoken", "rank").collect() == NB.topk_in_group(q, m, 7).orderBy("qtoken", "rank").collect()


def test_empty_tables_and_nulls(spark):
    m = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, None), ("c", None, [1.0, 1.0]), (None, 0, [0.0, 1.0]),
                               ("n", 0, [float("nan"), 1.0])], SCHEMA)
    q = m.selectExpr("token AS qtoken", "label", "vec AS qvec")
    assert PV.topk_pruned(q, m).rows.collect() == []
    assert PV.topk_pruned(q.limit(0), m.limit(0)).rows.collect() == []
