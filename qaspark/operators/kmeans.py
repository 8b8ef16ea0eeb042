"""K-means with very many groups (tens of thousands over a vocabulary).

Centroids are a table ``(label, vec)``. They start by k-means|| (Bahmani et al., 2012): in each
round every row becomes a candidate with a probability in proportion to its squared distance
from the candidates so far. Rounds of assignment keep two bounds with each row (Hamerly, 2010):
``upper``, on the distance from its own centroid, and ``lower``, on the distance from every
other one. Centroids move by known distances, which widen the bounds; a row whose ``upper`` stays
below ``lower`` keeps its label without a single distance, one that is below once ``upper`` is measured costs
one distance, and only the others are compared with all centroids. Rows, bounds and centroids are written each
round under the shared folder, so a lost executor costs part of a round.

Centroids of up to ``CENTROID_BYTES`` are sent to the tasks; the number of groups is a
parameter, so their size is known and checked before the first round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.operators.neighbors import CENTROID_BYTES
from qaspark.session import materialize

# FIXED VALUE - groups of the vocabulary expansion.
GROUPS = 30_000
#: Rows of a smaller vocabulary that make a group.
ROWS_PER_GROUP = 10
#: Distances are compared after rounding to so many decimals; the smallest label wins a tie.
DECIMALS = 9
_MARGIN = 1e-7
_STATE = "token string, vec array<double>, label int, upper double, lower double, cost long"


def group_count(rows: int) -> int:
    """30,000 groups, or a tenth as many as there are rows where these are few."""
    return max(1, min(GROUPS, rows // ROWS_PER_GROUP))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s])


def two_nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and distance of the nearest centroid of each row, the first among
    equals, and a distance that no other centroid is nearer than."""
    cc = (c * c).sum(axis=1)
    place, near, other = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), 256):
        part = x[at:at + 256]
        rough = np.maximum((part * part).sum(axis=1)[:, None] - 2 * part @ c.T + cc, 0.0)
        least = rough.min(axis=1)
        close = rough <= (least + 1e-7 * (1 + least))[:, None]
        for i in range(len(part)):
            js = np.flatnonzero(close[i])
            d = np.sqrt(((part[i] - c[js]) ** 2).sum(axis=1))
            j = int(np.round(d, DECIMALS).argmin())
            place[at + i], near[at + i] = js[j], d[j]
            if len(js) > 1:
                other[at + i] = np.delete(d, j).min()
        if len(c) > 1:
            rough[np.arange(len(part)), place[at:at + 256]] = np.inf
            second = rough.min(axis=1)
            second = np.sqrt(np.maximum(second - 1e-7 * (1 + second), 0.0))
            other[at:at + 256] = np.minimum(other[at:at + 256], second)
    return place, near, other


def _gather(cents: DataFrame) -> np.ndarray:
    """The centroids by label, checked to be small enough to send out."""
    size = cents.agg(F.sum(F.size("vec") * 8)).first()[0] or 0
    if size > CENTROID_BYTES:
        raise ValueError(f"{size} bytes of centroids; at most {CENTROID_BYTES} are sent to the tasks")
    rows = cents.orderBy("label").select("vec").toPandas()
    return _matrix(rows["vec"])


def start(vectors: DataFrame, k: int, rounds: int = 5, seed: int = 1) -> np.ndarray:
    """k-means||: about ``k / rounds`` candidates a round, then exactly ``k`` different
    ones (fewer, if there are not as many different rows)."""
    # A random number that depends on the row alone, so that a repeated task draws alike.
    def draw(r: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "token"), F.lit(1 << 40)) / float(1 << 40)

    first = vectors.orderBy(draw(0), "token").limit(1).select("vec").toPandas()
    if not len(first):
        return np.zeros((0, 0))
    held, state = _matrix(first["vec"]), None
    for r in range(1, rounds + 1):
        sent = vectors.sparkSession.sparkContext.broadcast(held if state is None else new)

        def nearer(frames):
            for f in frames:
                if len(f):
                    d = two_nearest(_matrix(f["vec"]), sent.value)[1] ** 2
                    yield f.assign(d=np.minimum(f["d"].to_numpy(), d))

        rows = vectors.select("token", "vec", F.lit(float("inf")).alias("d")) if state is None else state
        state = materialize(rows.mapInPandas(nearer, "token string, vec array<double>, d double"), "kmeans-start")
        total = state.agg(F.sum("d")).first()[0] or 0.0
        if total <= 0:
            break
        picked = state.where(draw(r) < F.col("d") * (k / rounds / total)).select("vec").toPandas()  # about k / rounds rows
        if not len(picked):
            new = held[:1]
            continue
        new = _matrix(picked["vec"])
        held = np.vstack([held, new])
    held = np.unique(held, axis=0)
    order = np.random.RandomState(seed).permutation(len(held))[:k]
    held = held[order]
    if len(held) < k:  # the farthest rows fill up
        more = state.where("d > 0").orderBy(F.desc("d"), "token").limit(2 * (k - len(held))).select("vec").toPandas()
        if len(more):
            extra = np.unique(_matrix(more["vec"]), axis=0)
            known = {v.tobytes() for v in held}
            held = np.vstack([held, *[v[None] for v in extra if v.tobytes() not in known][:k - len(held)]])
    return held


def _assign(state: DataFrame, c: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One round: labels, bounds and the distances that each row cost. ``moved``: how far
    each centroid is from where it was (None in the first round)."""
    sent = state.sparkSession.sparkContext.broadcast((c, moved))

    def run(frames):
        c, moved = sent.value
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["vec"])
            label, upper, lower = f["label"].to_numpy(np.int64).copy(), f["upper"].to_numpy().copy(), f["lower"].to_numpy().copy()
            cost = np.zeros(len(x), np.int64)
            todo = np.ones(len(x), bool)
            if moved is not None:
                # No other centroid came nearer than the largest move of another.
                order = np.argsort(-moved)
                far = np.where(label == order[0], moved[order[1]] if len(moved) > 1 else 0.0, moved[order[0]])
                upper, lower = upper + moved[label], lower - far
                todo = upper + _MARGIN >= lower
                at = np.flatnonzero(todo)
                upper[at] = np.sqrt(((x[at] - c[label[at]]) ** 2).sum(axis=1))
                cost[at] = 1
                todo[at] = upper[at] + _MARGIN >= lower[at]
            at = np.flatnonzero(todo)
            if len(at):
                label[at], upper[at], lower[at] = two_nearest(x[at], c)
                cost[at] += len(c)
            yield pd.DataFrame({"token": f["token"], "vec": f["vec"], "label": label.astype(np.int32), "upper": upper,
                                "lower": lower, "cost": cost})

    return materialize(state.mapInPandas(run, _STATE), "kmeans")


@dataclass
class Clustering:
    """``rows``: (token, vec, label, dist); ``centroids``: (label, vec); ``distances``: how
    many distances each round computed; ``moves``: the farthest a centroid moved after it."""
    rows: DataFrame
    centroids: DataFrame
    distances: list[int]
    moves: list[float]


def fit(vectors: DataFrame, k: int | None = None, max_rounds: int = 12, tolerance: float = 1e-3, seed: int = 1) -> Clustering | None:
    """Groups of ``(token, vec)``; None for an empty table. The last step is an assignment,
    so every row's label is its nearest centroid, ties to the smaller label. A
    centroid without rows stays where it is."""
    spark = vectors.sparkSession
    held = materialize(vectors.select("token", "vec"), "kmeans-rows")
    one = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not one["n"]:
        return None
    k = k or group_count(one["n"])
    if k * one["d"] * 8 > CENTROID_BYTES:
        raise ValueError(f"{k} centroids of {one['d']} numbers; at most {CENTROID_BYTES} bytes are sent to the tasks")
    c, moved = start(held, k, seed=seed), None
    state = held.select("*", F.lit(0).alias("label"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("cost"))
    distances, moves = [], []
    while True:
        state = _assign(state, c, moved)
        distances.append(state.agg(F.sum("cost")).first()[0])
        if len(distances) == max_rounds or (moves and moves[-1] <= tolerance):
            break
        means = (state.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))
                 .orderBy("label").toPandas())  # a row for each group
        new = c.copy()
        new[means["label"].to_numpy()] = _matrix(means["vec"])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1))
        moves.append(float(moved.max()))
        c = new
    table = materialize(spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "label int, vec array<double>"), "kmeans-centroids")
    rows = state.select("token", "vec", "label", F.col("upper").alias("dist"))
    return Clustering(rows, table, distances, moves)
