import numpy as np
import pytest

from qaspark.operators import kmeans as KM


def _frame(spark, x, parts=3):
    return spark.createDataFrame([(f"t{i:05d}", v) for i, v in enumerate(x.tolist())], "token string, vec array<double>").repartition(parts)


def _groups(rng, centres=30, each=25, d=6, spread=0.3):
    c = rng.normal(size=(centres, d)) * 6
    return np.vstack([c[i] + spread * rng.normal(size=(each, d)) for i in range(centres)])


def test_labels_are_the_nearest_centroids_and_distances_fall(spark):
    x = _groups(np.random.default_rng(1))
    got = KM.fit(_frame(spark, x), k=30, tolerance=0.0, max_rounds=8)
    c = np.stack([r["vec"] for r in got.centroids.orderBy("label").collect()])
    rows = got.rows.orderBy("token").collect()
    d = np.round(np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)), KM.DECIMALS)
    assert [r["label"] for r in rows] == d.argmin(axis=1).tolist()
    assert all(r["dist"] >= m - 1e-7 for r, m in zip(rows, d.min(axis=1)))
    # The first round compares every row with every centroid, the last few rows with any.
    assert got.distances[0] == len(x) * 30
    assert got.distances[-1] < 0.2 * got.distances[0] and got.distances[-1] <= got.distances[1]


def test_bounds_give_what_full_rounds_give(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    frame = _frame(spark, x)
    c = KM.start(KM.materialize(frame, "test"), 20)
    assert c.shape == (20, 5) and len(np.unique(c, axis=0)) == 20
    got = KM.fit(frame, k=20, tolerance=0.0, max_rounds=5)
    for _ in range(4):
        label = np.round(np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)), KM.DECIMALS).argmin(axis=1)
        c = np.stack([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(20)])
    assert np.stack([r["vec"] for r in got.centroids.orderBy("label").collect()]) == pytest.approx(c, abs=1e-9)


def test_few_rows_equal_rows_and_none(spark):
    assert KM.fit(_frame(spark, np.zeros((0, 3))).where("false")) is None
    same = KM.fit(_frame(spark, np.ones((12, 3))), k=4)
    assert {r["label"] for r in same.rows.collect()} == {0}
    few = KM.fit(_frame(spark, np.eye(3)), k=10)
    assert few.rows.select("label").distinct().count() == 3
    assert (KM.group_count(5), KM.group_count(5000), KM.group_count(10 ** 9)) == (1, 500, 30_000)
    with pytest.raises(ValueError):
        KM.fit(_frame(spark, np.ones((2, 3))), k=10 ** 9)
