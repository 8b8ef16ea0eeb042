import numpy as np
import pandas as pd
import pytest
from llm_fixtures import SF001, docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import queries, whitening
from qaspark.llm.symmetric_eigen import leading_eigenpairs, sturm_counts, tridiagonal

SF = SF001.replace("sf0.001", "sf0.01")


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.RandomState(seed).randn(len(values), len(values)))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [7.0], [3, 2], [1e6, 1e6, 1e6, 2, 1, 0], [10, 10 - 1e-9, 10 - 2e-9, 1, 1, 1, 0.5], [0, 0, 0],
    list(range(60, 0, -1)), [1e-8, 1e-9, 1e-12], [5, 0, 0, -3]])
def test_leading_eigenpairs(values):
    m = spectrum(values)
    k = min(8, len(values))
    got, v = leading_eigenpairs(m, k)
    size = max(1e-300, np.abs(values).max())
    assert np.abs(got - np.sort(values)[::-1][:k]).max() <= 1e-13 * size * len(values)
    assert np.abs(v @ v.T - np.eye(k)).max() < 1e-12
    assert np.abs(m @ v.T - v.T * got).max() <= 1e-12 * size


def test_tridiagonal_form_and_sturm_counts():
    m = spectrum([9, 5, 4, 4, 1, -2])
    d, e, reflections = tridiagonal(m)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    q = np.eye(6)
    for at, v in reflections:
        q[:, at:] -= 2 * np.outer(q[:, at:] @ v, v)
    assert np.abs(q @ t @ q.T - m).max() < 1e-12
    assert sturm_counts(d, e, np.array([-3, 0, 3, 4.5, 6, 10.0])).tolist() == [0, 1, 2, 4, 5, 6]
    diagonal = leading_eigenpairs(np.diag([1.0, 3.0, 2.0]), 2)
    assert diagonal[0].tolist() == pytest.approx([3, 2]) and np.abs(diagonal[1][0]).tolist() == pytest.approx([0, 1, 0])


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s.tolist(), strict=True)) for r in x.tolist()]
    return dev, y @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)


def test_query_equals_a_dense_decomposition(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF).toPandas()
    dev, white, share = brute(table.embedding.to_list())
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert wide.shape == white.shape
    assert np.abs(wide * np.sign((wide * white).sum(axis=0)) - white).max() < 1e-9
    assert got[got.component == 1].set_index("vec_id").loc[table.vec_id].deviation.tolist() == dev
    assert np.abs(got.groupby("component").explained.first().to_numpy() / share - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and set(got.n) == {len(table)}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened double, deviation string").select(
        "vec_id", whitening.whole_numbers(F.col("embedding"), 1024, 100_000).alias("x"), "whitened", "deviation")


def test_edges(spark):
    rng = np.random.RandomState(4)
    good = [(i, rng.randn(4).tolist()) for i in range(50)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [0.5] * 4)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0]), (92, [float("nan")] * 4), (93, [float("-inf")] * 4), (94, [1.0] * 3), (95, []), (96, [1e300] * 4)]
    rows = whitening.usable(frame(spark, good + bad), "x")
    model = whitening.fit(rows, "x", 8)
    out = whitening.apply(rows, model, "x").toPandas()
    assert model.n == len(out) == 54 and model.components.shape == (4, 4)
    dev, white, _ = brute([v for _, v in good])
    assert sorted(out.deviation) == sorted(dev)
    assert whitening.identity_error(whitening.apply(rows, model, "x"), 4) < 1e-9
    assert whitening.fit(whitening.usable(frame(spark, bad[:4]), "x"), "x") is None
    same = whitening.usable(frame(spark, [(i, [1.0, 2.0]) for i in range(5)]), "x")
    assert len(whitening.fit(same, "x").values) == 0
    flat = whitening.fit(whitening.usable(frame(spark, [(i, [float(i), 1.0]) for i in range(5)]), "x"), "x")
    assert flat.components.shape == (1, 2)  # no component without variance


def test_large_entries_stay_exact(spark):
    rows = [(i, [(-1.0) ** i * 9e8 + i, float(i)]) for i in range(6)]
    got = whitening.usable(frame(spark, rows), "x")
    model = whitening.fit(got, "x")
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((6 * a - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in x]
    assert [r.deviation for r in whitening.apply(got, model, "x").orderBy("vec_id").collect()] == [d if d < 1 << 63 else None for d in dev]


def test_no_row_gives_an_empty_result(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["op11_embedding_whitening"](spark, str(tmp_path)).collect() == []
    assert queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect() == []
