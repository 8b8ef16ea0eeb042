"""Nearest neighbours inside clusters, nearest centroids, vocabulary expansion.

The exact top-k search never materialises all pairs of a cluster as rows.
Each cluster's members are hashed into blocks of at most ``block`` rows and
its queries into blocks of at most ``qblock`` rows; every (query block,
member block) pair of a cluster is one ``cogroup`` task that computes its
distances with NumPy, a bounded tile of queries at a time, and emits only the
k best candidates per query.
A cluster holding a third of all rows therefore becomes many evenly sized
tasks. The per-query merge sees at most k rows per member block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions import vector as V

UNKNOWN = "UNKNOWN"
# FIXED VALUE - neighbours examined when a token borrows a vector.
TOP = 5
#: Bytes of vectors in one block, and of centroids sent to every task.
BLOCK_BYTES, CENTROID_BYTES = 16 << 20, 256 << 20
#: Bytes of distances that a task computes at a time.
TILE_BYTES = 16 << 20
_CAND = "qtoken string, token string, dist double"


def _chunks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))


def _block_rows(width: int) -> int:
    return max(64, BLOCK_BYTES // (8 * width))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s])


def _tiles(rows: int, cols: int) -> Iterator[slice]:
    """Slices of ``rows`` whose distances to ``cols`` others take some ``TILE_BYTES``."""
    step = max(1, TILE_BYTES // (8 * max(1, cols)))
    for at in range(0, rows, step):
        yield slice(at, min(rows, at + step))


def _own_places(qtok: pd.Series, mtok: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of each query's own token begin and end; ``mtok`` is sorted, nulls last."""
    codes, known = pd.factorize(mtok)
    asked = pd.Index(known).get_indexer(qtok)
    codes = np.where(codes < 0, len(known), codes)
    asked = np.where(qtok.isna().to_numpy(), len(known), np.where(asked < 0, len(known) + 1, asked))
    return np.searchsorted(codes, asked, "left"), np.searchsorted(codes, asked, "right")


def _nearest_members(qtok: pd.Series, qm: np.ndarray, mtok: pd.Series, mm: np.ndarray, k: int, decimals: int) -> pd.DataFrame:
    """The ``k`` nearest members of each query as ``(qtoken, token, dist)``; members are sorted by token. The
    distances of a tile of queries are held at a time."""
    qn, mn = np.linalg.norm(qm, axis=1), np.linalg.norm(mm, axis=1)
    lo, hi = _own_places(qtok, mtok)
    take = min(k, len(mm))
    found = []
    for tile in _tiles(len(qm), len(mm)):
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = qm[tile] @ mm.T
            dist /= np.outer(qn[tile], mn)
            np.subtract(1.0, dist, out=dist)
        dist[~np.isfinite(dist)] = np.inf
        for i in np.flatnonzero(hi[tile] > lo[tile]):
            dist[i, lo[tile][i]:hi[tile][i]] = np.inf
        # Whatever rounds to the k-th distance or less lies within one unit of the last place of it.
        last = np.partition(dist, take - 1, axis=1)[:, take - 1] + 10.0 ** -decimals
        i, j = np.nonzero((dist <= last[:, None]) & (dist < np.inf))
        d = np.round(dist[i, j], decimals)
        order = np.lexsort((j, d, i))  # members are sorted by token: ties by token
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(dist.shape[0]))
        best = np.arange(len(i)) - first[i] < take
        found.append((i[best] + tile.start, j[best], d[best]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"qtoken": qtok.to_numpy()[i], "token": mtok.to_numpy()[j], "dist": d})


def topk_in_group(queries: DataFrame, members: DataFrame, k: int = TOP, block: int | None = None,
                  qblock: int | None = None, decimals: int = 6) -> DataFrame:
    """Exact k nearest members (cosine distance) of each query within its group.

    ``queries``: ``(qtoken, label, qvec)``; ``members``: ``(token, label, vec)``.
    A query never matches a member with its own token. Ties are broken by
    distance rounded to ``decimals``, then token. Returns
    ``(qtoken, rank, token, dist)`` with ``rank`` 1..k."""
    if block is None or qblock is None:  # blocks of equal bytes: few copies of either side
        row = members.select(F.size("vec").alias("d")).first()
        rows = _block_rows(row["d"] if row else 1)
        block, qblock = block or rows, qblock or rows
    # Fresh column identities: both sides often come from the same table.
    members = members.select(*[F.col(c).alias(c) for c in ("token", "label", "vec")])
    queries = queries.select(*[F.col(c).alias(c) for c in ("qtoken", "label", "qvec")])
    mc = _chunks(members, "label", block, "n_m")
    qc = _chunks(queries, "label", qblock, "n_q")
    sizes = mc.join(qc, "label").select(F.col("label").alias("label"), "n_m", "n_q")  # one row per group
    m = (members.join(sizes, "label")
         .withColumn("mb", F.pmod(F.xxhash64("token"), F.col("n_m")).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
         .select("label", "qb", "mb", "token", "vec"))
    q = (queries.join(sizes, "label")
         .withColumn("qb", F.pmod(F.xxhash64("qtoken"), F.col("n_q")).cast("int"))
         .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)))
         .select("label", "qb", "mb", "qtoken", "qvec"))

    def block_topk(qp: pd.DataFrame, mp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or mp.empty:
            return pd.DataFrame(columns=["qtoken", "token", "dist"])
        mp = mp.sort_values("token", kind="stable")
        return _nearest_members(qp["qtoken"], _matrix(qp["qvec"]), mp["token"], _matrix(mp["vec"]), k, decimals)

    cand = q.groupBy("label", "qb", "mb").cogroup(m.groupBy("label", "qb", "mb")).applyInPandas(block_topk, _CAND)
    w = Window.partitionBy("qtoken").orderBy("dist", "token")  # <= k rows per member block
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qtoken", "rank", "token", "dist"))


def centroids(vectors: DataFrame, label_col: str = "label") -> DataFrame:
    """Mean vector per label ``(label, vec)``."""
    return vectors.groupBy(label_col).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("vec"))


def _nearest(x: np.ndarray, c: np.ndarray, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and rounded distance of the nearest centroid of each row, the
    first among equals: |x|^2 - 2 x.c + |c|^2 finds it up to rounding, what
    lies that near is measured again exactly."""
    cc = (c * c).sum(axis=1)
    place, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 256):
        part = x[at:at + 256]
        rough = (part * part).sum(axis=1)[:, None] - 2 * part @ c.T + cc
        least = rough.min(axis=1)
        near = rough <= (least + 1e-7 * (1 + np.abs(least)))[:, None]
        for i in range(len(part)):
            js = np.flatnonzero(near[i])
            d = np.round(np.sqrt(((part[i] - c[js]) ** 2).sum(axis=1)), decimals)
            j = int(d.argmin())
            place[at + i], dist[at + i] = js[j], d[j]
    return place, dist


def assign_nearest(vectors: DataFrame, cents: DataFrame, decimals: int = 9) -> DataFrame:
    """Nearest centroid (Euclidean) of every ``(token, vec)`` row; ties go to
    the lowest label. Centroids of up to ``CENTROID_BYTES`` are sent to every
    task; more are cut into blocks that meet the vectors in ``cogroup`` tasks."""
    size = cents.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0
    if size > CENTROID_BYTES:
        return _assign_in_blocks(vectors, cents, decimals)
    rows = sorted(cents.collect(), key=lambda r: r["label"])
    if not rows:
        return vectors.select("token", F.lit(None).cast("int").alias("label"))
    labels = np.array([r["label"] for r in rows])
    cm = np.stack([np.asarray(r["vec"], dtype=np.float64) for r in rows])
    bc = vectors.sparkSession.sparkContext.broadcast((labels, cm))

    def run(batches):
        lab, c = bc.value
        for pdf in batches:
            if not pdf.empty:
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
                yield pd.DataFrame({"token": pdf["token"].to_numpy(), "label": lab[_nearest(x, c, decimals)[0]]})

    return vectors.select("token", "vec").mapInPandas(run, "token string, label int")


def _assign_in_blocks(vectors: DataFrame, cents: DataFrame, decimals: int) -> DataFrame:
    """Blocks of vectors against blocks of centroids; the best per vector wins."""
    width = cents.select(F.size("vec").alias("d")).first()["d"]
    rows = _block_rows(width)
    n_c = max(1, -(-cents.count() // rows))
    n_v = max(1, -(-vectors.count() // rows))
    c = (cents.withColumn("cb", F.pmod(F.xxhash64("label"), F.lit(n_c)).cast("int"))
         .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))))
    v = (vectors.select("token", F.col("vec").alias("x"))
         .withColumn("vb", F.pmod(F.xxhash64("token"), F.lit(n_v)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))))

    def block(xs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if xs.empty or cs.empty:
            return pd.DataFrame({"token": [], "label": [], "dist": []})
        cs = cs.sort_values("label")
        x = np.stack([np.asarray(u, dtype=np.float64) for u in xs["x"]])
        m = np.stack([np.asarray(u, dtype=np.float64) for u in cs["vec"]])
        place, dist = _nearest(x, m, decimals)
        return pd.DataFrame({"token": xs["token"].to_numpy(), "label": cs["label"].to_numpy()[place], "dist": dist})

    found = v.groupBy("vb", "cb").cogroup(c.groupBy("vb", "cb")).applyInPandas(block, "token string, label int, dist double")
    return found.groupBy("token").agg(F.min(F.struct("dist", "label"))["label"].alias("label"))


def expand_vocabulary(tokens: DataFrame, main: DataFrame, other: DataFrame, other_labels: DataFrame,
                      query_labels: DataFrame | None = None, top: int = TOP,
                      unknown=None) -> DataFrame:
    """Vector for every token: its main-model vector if present; otherwise,
    among the ``top`` nearest other-model tokens of its cluster (its own
    other-model vector decides the cluster), the first that has a main
    vector; otherwise the token is dropped.

    ``other_labels``: ``(token, label)`` cluster of each other-model token;
    ``query_labels``: cluster of the tokens being expanded, as
    :func:`assign_nearest` gives it (defaults to ``other_labels``).
    ``unknown``: a vector added as the row of the token UNKNOWN.
    Returns ``(token, how, source, vec)`` with ``how`` in direct/expanded/unknown."""
    toks = tokens.select("token").distinct()
    direct = toks.join(main, "token").select("token", F.lit("direct").alias("how"),
                                             F.col("token").alias("source"), "vec")
    need = toks.join(main.select("token"), "token", "left_anti")
    qlab = query_labels if query_labels is not None else other_labels
    queries = (need.join(other.select("token", F.col("vec").alias("qvec")), "token")
               .join(qlab, "token").select(F.col("token").alias("qtoken"), "label", "qvec"))
    members = other.join(other_labels, "token").select("token", "label", "vec")
    near = topk_in_group(queries, members, top)
    owned = near.join(main.select("token", "vec"), "token")
    best = owned.groupBy("qtoken").agg(F.min_by(F.struct("token", "vec"), "rank").alias("b"))
    expanded = best.select(F.col("qtoken").alias("token"), F.lit("expanded").alias("how"),
                           F.col("b.token").alias("source"), F.col("b.vec").alias("vec"))
    out = direct.unionByName(expanded)
    if unknown is not None:
        row = tokens.sparkSession.range(1).select(
            F.lit(UNKNOWN).alias("token"), F.lit("unknown").alias("how"), F.lit(None).cast("string").alias("source"),
            V.literal(unknown).alias("vec"))
        out = out.where(F.col("token") != UNKNOWN).unionByName(row)
    return out
