import numpy as np
import pandas as pd
from llm_fixtures import SF001, docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import hard_negatives as hn
from qaspark.llm import queries

SF = SF001.replace("sf0.001", "sf0.01")
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(ids, labels, x, n_pos=5, n_neg=3):
    out = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == labels[i] and j != i][:n_pos]:
            fit = [j for j in order if labels[j] != labels[i] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:n_neg]
            out |= {(int(ids[i]), int(ids[p]), r + 1, int(ids[j]), int(s[p]), int(s[j])) for r, j in enumerate(fit)}
    return out


def rows_of(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


def test_query_equals_brute_force(spark):
    t = pd.read_parquet(f"{SF}/embeddings.parquet")
    labels = np.where(t.vec_id % 7 == 0, (t.label + 1) % 10, t.label)
    x = np.floor(256 * np.array(t.embedding.to_list(), np.float64)).astype(np.int64)
    got = queries.QUERIES["op12_hard_negatives"](spark, SF)
    assert got.count() == len(rows_of(got))
    assert rows_of(got) == brute(t.vec_id.to_numpy(), labels, x)


def test_many_cells_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hn, "GROUP", 4)
    rng = np.random.RandomState(8)
    x = np.concatenate((rng.randint(-40, 40, (500, 6)), rng.randint(-2, 3, (300, 6)), np.tile([9, 9, 0, 0, 9, 9], (250, 1))))
    ids = rng.permutation(len(x)) - 30  # negative ids too
    labels = rng.randint(0, 3, len(x))
    frame = spark.createDataFrame([(int(i), v, int(y), "x", 1) for i, v, y in zip(ids, x.tolist(), labels, strict=True)],
                                  "vec_id long, embedding array<long>, label int, cell string, rank int").repartition(5)
    for codes in (1, 7):
        assert rows_of(hn.mine(frame, F.col("id") % 50 == 0, codes=codes)) == brute(ids, labels, x)


def test_edges(spark):
    rows = [(0, [4, 4], 1), (1, [4, 3], 1), (2, [3, 3], 2), (3, [1, 1], 2), (50, [1, 0], 7), (4, None, 1), (5, [4, 4], None), (6, [4, None], 2),
            (7, [1 << 21, 0], 2), (8, [1, 1, 1], 2), (None, [3, 3], 2), (2, [3, 3], 2), (2, [2, 9], 3), (9, [], 2), (100, [0, 0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<long>, label int")
    # 0: 1 is its positive (28); 2 (24) lies in 14 .. 26.6, 3 (8) and 50 (4) below; 100 is the second positive with
    # score 0. To 100 all scores are 0.
    want = {(0, 1, 1, 2, 28, 24)} | {(100, p, r + 1, n, 0, 0) for p in (0, 1) for r, n in enumerate((2, 3, 50))}
    assert rows_of(hn.mine(frame, F.col("id") % 50 == 0)) == want
    assert hn.mine(frame.where("vec_id is null"), F.col("id") % 50 == 0).count() == 0
    assert hn.mine(frame, F.col("id") == 50).count() == 0  # alone with its label
    assert hn.mine(frame, F.col("id") == 12345).count() == 0


def test_cells_come_by_falling_sum():
    rng = np.random.RandomState(2)
    a, b = rng.randn(7), rng.randn(5)
    got = list(hn.by_falling_sum(a, b))
    assert len({(i, j) for _, i, j in got}) == 35
    assert [s for s, _, _ in got] == sorted((a[:, None] + b).ravel().tolist(), reverse=True)
    assert all(abs(s - a[i] - b[j]) < 1e-12 for s, i, j in got)


def test_bounds_hold_and_walks_share_the_cells(spark):
    rng = np.random.RandomState(3)
    x = rng.randint(-99, 99, (400, 7))
    codes = hn.Codes(x, 4)
    cell, far = codes.place(x)
    for c in range(16):
        m = cell == c
        if m.any():
            codes.blocks[divmod(c, 4)] = 1
            codes.radii[0][divmod(c, 4)], codes.radii[1][divmod(c, 4)] = far[m].max(axis=0)
    for a, (tops, high, low) in zip(x[:40], codes.bounds(x[:40]), strict=True):
        s = x @ a
        assert (s <= high.ravel()[cell]).all() and (s >= low.ravel()[cell]).all()
        assert ((tops[0][:, None] + tops[1]).ravel()[cell] + 1e-6 * np.abs(s).max() >= s).all()
        kth = np.sort(s)[-5]
        least, most = np.array([kth]), np.array([1 << 53])
        first = hn.walk(tops, high, low, least, most, 3, False)
        rest = hn.walk(tops, high, low, least, most, 3, True)
        assert not set(first) & set(rest)
        assert {tuple(divmod(c, 4)) for c in cell[s >= kth].tolist()} <= set(first) | set(rest)
