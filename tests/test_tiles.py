import tracemalloc

import numpy as np
import pandas as pd

from qaspark.operators import neighbors as NB
from qaspark.operators import pivots as PV


def _brute(rows, k):
    out = {}
    for t, lab, v in rows:
        near = sorted((round(1 - float(np.dot(v, w)) / (np.linalg.norm(v) * np.linalg.norm(w)), 6), u)
                      for u, other, w in rows if other == lab and u != t)
        out[t] = [u for _, u in near[:k]]
    return out


def _found(rows):
    out = {}
    for r in rows.orderBy("qtoken", "rank").collect():
        out.setdefault(r["qtoken"], []).append(r["token"])
    return out


def test_distances_of_large_blocks_take_bounded_memory():
    rng = np.random.default_rng(3)
    tok, m = pd.Series([f"t{i:05d}" for i in range(6000)]), rng.normal(size=(6000, 4))
    tracemalloc.start()
    got = NB._nearest_members(tok, m, tok, m, 5, 6)  # 288 MB of distances
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and len(got) == 30000 and not (got["qtoken"] == got["token"]).any()


def test_small_tiles_find_the_same_members(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"t{i:03d}", i % 2, rng.normal(size=5).tolist()) for i in range(120)] + [(f"same{i}", 0, [1.0] * 5) for i in range(9)]
    m = spark.createDataFrame(rows, "token string, label int, vec array<double>")
    q = m.selectExpr("token AS qtoken", "label", "vec AS qvec")
    monkeypatch.setattr(NB, "TILE_BYTES", 8 * 300)
    assert _found(NB.topk_in_group(q, m, 5)) == _brute(rows, 5)


def test_second_round_in_many_blocks_and_split_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"t{i:03d}", i % 2, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(f"copy{i:02d}", 0, rows[0][2]) for i in range(90)]  # one cell larger than a block
    m = spark.createDataFrame(rows, "token string, label int, vec array<double>")
    monkeypatch.setattr(NB, "_block_rows", lambda width: 64)
    s = PV.topk_pruned(m.selectExpr("token AS qtoken", "label", "vec AS qvec"), m, k=5, cell_rows=20)
    assert _found(s.rows) == _brute(rows, 5)
