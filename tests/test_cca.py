import numpy as np
import pandas as pd
import pytest

from qaspark.operators import cca as CCA


def _frame(spark, n=300, d=4, seed=0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, d))
    a = q @ rng.normal(size=(d, d)) + 0.1 * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, q[i].tolist(), a[i].tolist()) for i in range(n)],
                                 "id int, qv array<double>, av array<double>"), q, a


def test_gram_sums(spark):
    df, q, a = _frame(spark)
    g = CCA.gram_sums(df, "qv", "av", full_qq=True)
    assert g["n"] == 300
    assert g["qa"] == pytest.approx(q.T @ a)
    assert g["qq"] == pytest.approx(q.T @ q)


def test_two_stage_from_one_pass_equals_explicit(spark):
    df, q, a = _frame(spark)
    para = CCA.CCAModel(np.eye(4)[:, :2] + 0.1, np.eye(4)[:, 2:] - 0.2, np.array([]))
    m = CCA.fit_two_stage(df, "qv", "av", para)
    p = np.hstack([para.q, para.a])
    qp = q @ p
    direct = CCA.fit_from_grams(qp.T @ a, (qp * qp).sum(0), (a * a).sum(0), len(q))
    def dists(model, x, y):
        u, v = x @ model.q, y @ model.a
        return 1 - (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
    assert dists(m, qp, a) == pytest.approx(dists(direct, qp, a), abs=1e-9)


def test_scale_invariance_and_scoring(spark):
    df, q, a = _frame(spark)
    m = CCA.fit(df, "qv", "av")
    scaled = CCA.fit_from_grams(q.T @ a * 4.0, (q * q).sum(0) * 4.0, (a * a).sum(0), 300)
    s1 = {r["id"]: r["dist"] for r in CCA.score(df, "qv", "av", m).collect()}
    u, v = q @ scaled.q, a @ scaled.a
    d2 = 1 - (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
    assert [s1[i] for i in range(300)] == pytest.approx(d2.tolist(), abs=1e-9)


def test_sparse_cca_matches_dense_svd(spark):
    from qaspark.operators import sparse_cca as SC
    rng = np.random.default_rng(3)
    rows = []
    for rid in range(40):
        for side, w in (("q", 8), ("a", 6)):
            for idx in rng.choice(w, size=3, replace=False):
                rows.append((rid, side, int(idx), float(rng.integers(1, 4))))
    df = spark.createDataFrame(rows, "row_id long, side string, idx long, cnt double")
    model, s = SC.sparse_factors(df, k=3, oversample=3, power_iters=2)
    t = dense_reference(rows, 8, 6)
    s_dense = np.linalg.svd(t, compute_uv=False)
    assert s == pytest.approx(s_dense[:3], rel=1e-6)
    # The projections diagonalise the covariance they were fitted on.
    u, v = np.zeros((8, 3)), np.zeros((6, 3))
    for r in model.collect():
        (u if r.side == "q" else v)[r.idx] = r.w
    qm, am = np.zeros((40, 8)), np.zeros((40, 6))
    for rid, side, idx, cnt in rows:
        (qm if side == "q" else am)[rid, idx] += cnt
    assert u.T @ (qm.T @ am / 40) @ v == pytest.approx(np.diag(s), abs=1e-8)


def dense_reference(features_rows: list[tuple[int, str, int, float]], wq_n: int, wa_n: int) -> np.ndarray:
    """Dense ``T`` for tests on small fixtures."""
    rows = sorted({r[0] for r in features_rows})
    pos = {r: i for i, r in enumerate(rows)}
    qm, am = np.zeros((len(rows), wq_n)), np.zeros((len(rows), wa_n))
    for rid, side, idx, cnt in features_rows:
        (qm if side == "q" else am)[pos[rid], idx] += cnt
    n = len(rows)
    dq, da = (qm * qm).sum(0), (am * am).sum(0)
    wq = np.where(dq > 0, 1 / np.sqrt(np.where(dq > 0, dq, 1)), 0) / n
    wa = np.where(da > 0, 1 / np.sqrt(np.where(da > 0, da, 1)), 0) / n
    return (wq[:, None] * (qm.T @ am / n)) * wa[None, :]


def _sparse_rows(rng, n, sides):
    return [(i, side, int(idx), float(rng.integers(1, 4))) for i in range(n) for side, w in sides
            for idx in rng.choice(w, size=3, replace=False)]


def _dense(rows, side, n, w):
    m = np.zeros((n, w))
    for i, s, idx, c in rows:
        if s == side:
            m[i, idx] += c
    return m


def test_sparse_two_stage_equals_dense(spark):
    from qaspark.operators import sparse_cca as SC
    rng = np.random.default_rng(7)
    schema = "row_id long, side string, idx long, cnt double"
    rows, prows = _sparse_rows(rng, 50, (("q", 9), ("a", 7))), _sparse_rows(rng, 40, (("q", 9), ("a", 8)))
    features, para_rows = spark.createDataFrame(rows, schema), spark.createDataFrame(prows, schema)
    para, _ = SC.sparse_factors(para_rows, k=3, oversample=6)
    p = np.zeros((9, 6))  # index 8 occurs on one side of the paraphrases only
    for r in para.collect():
        p[r["idx"], (0 if r["side"] == "q" else 3):(3 if r["side"] == "q" else 6)] = r["w"]
    q, a = _dense(rows, "q", 50, 9), _dense(rows, "a", 50, 7)
    dense = CCA.fit_from_grams(p.T @ (q.T @ a), np.einsum("ij,ik,kj->j", p, q.T @ q, p), (a * a).sum(0), 50)
    mapped = SC.question_map(para)
    answers, qm, s = SC.two_stage_factors(features, mapped)
    live = dense.s > 1e-12 * dense.s[0]
    assert s == pytest.approx(dense.s[live], rel=1e-6)
    am = np.zeros((7, len(s)))
    for r in answers.collect():
        am[r["idx"]] = r["w"]
    assert (qm * s) @ am.T == pytest.approx((dense.q[:, live] * dense.s[live]) @ dense.a[:, live].T, rel=1e-5, abs=1e-18)
    # Scores of the model table and of the dense matrices.
    got = {r["row_id"]: r["dist"] for r in SC.score(features, SC.two_stage_model(features, mapped, 2)).collect()}
    u, v = q @ p @ dense.q[:, :2], a @ dense.a[:, :2]
    want = 1 - (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
    assert [got[i] for i in range(50)] == pytest.approx(want.tolist(), abs=1e-7)


def test_sparse_scores_given_a_model_table(spark):
    import duckdb

    from qaspark.operators import sparse_cca as SC
    rng = np.random.default_rng(9)
    rows = _sparse_rows(rng, 30, (("q", 12), ("a", 9))) + [(99, "q", 3, 1.0), (98, "a", 77, 2.0)]
    f = pd.DataFrame(rows, columns=["row_id", "side", "idx", "cnt"])
    m = pd.DataFrame([(s, i, rng.normal(size=4).tolist()) for s, w in (("q", 12), ("a", 9)) for i in range(w)], columns=["side", "idx", "w"])
    frame = spark.createDataFrame(rows, "row_id long, side string, idx long, cnt double")
    model = spark.createDataFrame(m.to_records(index=False).tolist(), "side string, idx long, w array<double>")
    got = {r["row_id"]: r["dist"] for r in SC.score(frame, model).collect()}
    want = duckdb.sql("""
        WITH e AS (SELECT side, idx, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM m),
        v AS (SELECT f.row_id, f.side, j, sum(cnt * x) AS v FROM f JOIN e ON e.side = f.side AND e.idx = f.idx GROUP BY ALL)
        SELECT q.row_id, 1 - sum(q.v * a.v) / sqrt(sum(q.v * q.v) * sum(a.v * a.v)) AS d
        FROM v q JOIN v a ON a.row_id = q.row_id AND a.j = q.j AND a.side = 'a' WHERE q.side = 'q' GROUP BY q.row_id""").fetchall()
    assert len(want) == 30 and all(abs(got[i] - d) < 1e-9 for i, d in want)
    assert got[99] is None and got[98] is None
    plain = {r["row_id"]: r["dist"] for r in SC.score(frame).collect()}
    a, b = _dense(rows[:-2], "q", 30, 12), _dense(rows[:-2], "a", 30, 12)
    assert [plain[i] for i in range(30)] == pytest.approx((1 - (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)).tolist())


def test_sums_of_several_data_sets_from_one_scan(spark):
    df, q, a = _frame(spark)
    df = df.withColumn("every", df.id >= 0).withColumn("few", df.id % 7 == 0).withColumn("none", df.id < 0)
    got = CCA.gram_sums_by(df, "qv", "av", ["every", "few", "none"], full_qq=True)
    for name, at in (("every", slice(None)), ("few", slice(0, None, 7))):
        assert got[name]["qa"] == pytest.approx(q[at].T @ a[at]) and got[name]["qq"] == pytest.approx(q[at].T @ q[at])
        assert got[name]["aa"][0] == pytest.approx((a[at] * a[at]).sum(0)) and got[name]["n"] == len(q[at])
    assert got["none"]["n"] == 0


def test_sweep_models_equal_separate_fits(spark):
    from qaspark.plans import pipelines as P
    df, q, a = _frame(spark, 120)
    features = df.selectExpr("id AS conv_id", "0 AS turn", "qv", "av")
    kept = features.where("conv_id % 3 = 0").select("conv_id", "turn")
    grams = P.dataset_grams(features, {"full": None, "filtered": kept})
    for name, rows in (("full", features), ("filtered", features.join(kept, ["conv_id", "turn"], "left_semi"))):
        g = grams[name]
        one = CCA.fit_from_grams(g["qa"], np.diagonal(g["qq"]), g["aa"][0], g["n"])
        apart = CCA.fit(rows, "qv", "av")
        assert (one.q * one.s) @ one.a.T == pytest.approx((apart.q * apart.s) @ apart.a.T)
        para = _para(4)
        two, alone = CCA.two_stage_from_grams(g, para), CCA.fit_two_stage(rows, "qv", "av", para)
        assert (two.q * two.s) @ two.a.T == pytest.approx((alone.q * alone.s) @ alone.a.T)


def _para(d):
    return CCA.CCAModel(np.eye(d)[:, :2] + 0.1, np.eye(d)[:, 2:] - 0.2, np.array([]))


def test_sparse_products_join_indices_not_entries(spark, monkeypatch):
    """Chunks multiplied and added up equal the dense product; rows and indices that lack the other side are left out."""
    from qaspark.operators import sparse_cca as SC

    monkeypatch.setattr(SC, "CHUNK", 50)
    rng = np.random.default_rng(11)
    entries = {(int(r), s, int(i)): float(rng.integers(1, 5)) for s in "qa" for r, i in zip(rng.integers(0, 40, 150), rng.integers(0, 12, 150))}
    entries |= {(100, "q", 50): 1.0, (101, "a", 60): 2.0, (102, "q", 3): 7.0}
    white = spark.createDataFrame([(f"r{r}", s, i, c) for (r, s, i), c in entries.items()] + [(None, "q", 3, 1.0), (None, "a", 3, 1.0)],
                                  "row_id string, side string, idx long, cnt double")
    dense = {s: np.zeros((103, 61)) for s in "qa"}
    for (r, s, i), c in entries.items():
        dense[s][r, i] = c
    given = rng.standard_normal((61, 3))
    factor = spark.createDataFrame([(i, given[i].tolist()) for i in range(61)], "idx long, w array<double>")
    chunks, places = SC._chunks(white)
    assert chunks.count() > 3
    both = (dense["q"].any(axis=1) & dense["a"].any(axis=1))[:, None]
    for by, to in ("aq", "qa"):
        product = SC._chunk_times(chunks, places, factor, by, to, 4.0)
        got = {r["idx"]: r["w"] for r in product.collect()}
        assert set(got) == set(np.flatnonzero((dense[to] * both).any(axis=0)).tolist())
        want = dense[to].T @ (dense[by] @ given) / 4
        assert all(np.allclose(w, want[i]) for i, w in got.items())


def test_vectors_of_an_index_are_added_up_in_parts(monkeypatch):
    import pyarrow as pa

    from qaspark.operators import sparse_cca as SC

    monkeypatch.setattr(SC, "GATHER", 3)
    batches = [pa.RecordBatch.from_pydict({"idx": pa.array(i, pa.int64()), "w": pa.array([[float(x), 1.0] for x in i], pa.list_(pa.float64()))})
               for i in ([5, 2], [], [2, 5], [9], [5])]
    got = {r["idx"]: r["w"] for b in SC._sums(iter(batches)) for r in b.to_pylist()}
    assert got == {2: [4.0, 2.0], 5: [15.0, 3.0], 9: [9.0, 1.0]} and list(SC._sums(iter([]))) == []


def test_features_of_a_query_are_formed_once(spark, monkeypatch):
    """Models and distances read the written features: the word vectors meet the sentences once for the pairs and once for the paraphrases."""
    from conftest import SF001

    from qaspark.operators import vectors as VEC
    from qaspark.plans import q_cca

    formed, rare = [], []
    own, unknown = VEC.sentence_vectors, VEC.unknown_values
    monkeypatch.setattr(VEC, "sentence_vectors", lambda *a, **k: formed.append(1) or own(*a, **k))
    monkeypatch.setattr(VEC, "unknown_values", lambda *a, **k: rare.append(1) or unknown(*a, **k))
    got = q_cca.cca_scores(spark, SF001)
    assert "artifact" not in got._jdf.queryExecution().optimizedPlan().toString() and (len(formed), len(rare)) == (2, 1)
    assert {r["stage"] for r in got.select("stage").distinct().collect()} == {0, 1, 2}
    formed.clear()
    wide = q_cca.cca_wide_product(spark, SF001)
    assert len(formed) == 1 and wide.count() > 0
