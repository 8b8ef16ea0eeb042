import numpy as np
import pytest

from qaspark.operators import cca as CCA
from qaspark.operators import wide_cca as W

SCHEMA = "id int, qv array<double>, av array<double>"


def _rows(spark, q, a, parts=4):
    return spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(q, a))], SCHEMA).repartition(parts)


def _data(n, d_q, d_a, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 6)) * [8, 5, 3, 2, 1, 0.5]
    q = z @ rng.normal(size=(6, d_q)) + 0.3 * rng.normal(size=(n, d_q))
    return q, z @ rng.normal(size=(6, d_a)) + 0.3 * rng.normal(size=(n, d_a))


def _matrices(model, d_q, d_a):
    k = len(model.first()["w"])
    m = {"q": np.zeros((d_q, k)), "a": np.zeros((d_a, k))}
    for r in model.collect():
        m[r["side"]][r["idx"]] = r["w"]
    return m["q"], m["a"]


def test_tiles_equal_the_sums_in_any_number_of_stripes(spark):
    q, a = _data(50, 13, 9)
    df = _rows(spark, q, a)
    for stripe in (None, 8 * 9 * 5):
        c, diag = np.zeros((13, 9)), {"qq": np.zeros(13), "aa": np.zeros(9)}
        for r in W.gram_tiles(df, "qv", "av", block=4, stripe_bytes=stripe).collect():
            at = slice(r["jb"] * 4, r["jb"] * 4 + len(r["row"]))
            if r["kind"] == "qa":
                c[r["i"], at] = r["row"]
            elif r["kind"] != "n":
                diag[r["kind"]][at] = r["row"]
            else:
                assert r["row"] == [50.0]
        assert c == pytest.approx(q.T @ a)
        assert diag["qq"] == pytest.approx((q * q).sum(0)) and diag["aa"] == pytest.approx((a * a).sum(0))


def test_whole_model_equals_the_dense_one(spark):
    q, a = _data(60, 11, 7)
    q[:, 4] = 0  # a dead dimension
    model, s, _ = W.fit(_rows(spark, q, a), "qv", "av", block=4)
    dense = CCA.fit_from_grams(q.T @ a, (q * q).sum(0), (a * a).sum(0), 60.0)
    assert s == pytest.approx(dense.s, rel=1e-7)
    mq, ma = _matrices(model, 11, 7)
    assert (mq * s) @ ma.T == pytest.approx((dense.q * dense.s) @ dense.a.T, abs=1e-12)
    assert not mq[4].any()


def test_width_6000_with_small_matrices_only_on_the_driver(spark, monkeypatch):
    n, d_q, d_a, k = 40, 6000, 1200, 2
    q, a = _data(n, d_q, d_a, 1)
    seen = []
    gram = W.SC._gram
    monkeypatch.setattr(W.SC, "_gram", lambda f, r: seen.append(r) or gram(f, r))
    model, s, _ = W.fit(_rows(spark, q, a, 2), "qv", "av", k, oversample=6, tol=1e-8)
    assert max(seen) <= k + 6
    wq, wa = 1 / (np.sqrt((q * q).sum(0)) * n), 1 / (np.sqrt((a * a).sum(0)) * n)
    # T = (Wq Q^T)(A Wa) / n has rank n at most: its values from two thin factors.
    u, r1 = np.linalg.qr((q * wq).T)
    v, r2 = np.linalg.qr((a * wa).T)
    x, want, y = np.linalg.svd(r1 @ r2.T / n)
    assert s == pytest.approx(want[:k], rel=1e-7)
    mq, ma = _matrices(model, d_q, d_a)
    dense = (wq[:, None] * (u @ x[:, :k])) * want[:k] @ (wa[:, None] * (v @ y[:k].T)).T
    assert np.abs((mq * s) @ ma.T - dense).max() <= 1e-3 * np.abs(dense).max()


def test_two_stages_and_scores_by_broadcast_and_by_join(spark, monkeypatch):
    q, a = _data(40, 9, 6)
    p1, p2 = _data(40, 9, 9, 3)
    df = _rows(spark, q, a)
    para, _, _ = W.fit(_rows(spark, p1, p2), "qv", "av", 2, block=4)
    _, model, s = W.fit_two_stage(df, "id", "qv", "av", para, 2, block=4)
    z = q @ np.hstack(_matrices(para, 9, 9))
    dense = CCA.fit_from_grams(z.T @ a, (z * z).sum(0), (a * a).sum(0), 40.0, 2)
    assert s == pytest.approx(dense.s, rel=1e-6)
    u, v = z @ dense.q, a @ dense.a
    want = 1 - (u * v).sum(1) / np.linalg.norm(u, axis=1) / np.linalg.norm(v, axis=1)
    for limit in (W.FACTOR_BYTES, 0):
        monkeypatch.setattr(W, "FACTOR_BYTES", limit)
        got = {r["id"]: r["dist"] for r in W.score(df, "id", "qv", "av", model, para).collect()}
        assert [got[i] for i in range(40)] == pytest.approx(want.tolist(), abs=1e-7)


def test_no_rows(spark):
    with pytest.raises(ValueError):
        W.fit(spark.createDataFrame([], SCHEMA), "qv", "av", 2)
