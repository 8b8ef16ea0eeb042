"""CCA over dense features too wide for one matrix on the driver.

The sums ``C = sum q a^T`` are accumulated in tiles: every task folds its rows into a
stripe of C of at most ``STRIPE_BYTES`` (a wider C takes one scan a stripe), and the partial sums
meet per ``(row of C, block of columns)``. The whitened ``T = Dqq^-1/2 C Daa^-1/2`` is
a table of tile rows. Its leading singular triplets come from subspace iteration with a
random start: a product with T or T^T is one task per tile, T and the tile's part of the factor
met in a ``cogroup``, and a sum per index. The driver holds r x r Gram matrices only
(r = k + oversampling); C, T and both factors stay tables.

A model is a table ``(side, idx, w)``, as for sparse features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.vector import cosine_distance
from qaspark.operators import sparse_cca as SC
from qaspark.session import materialize

#: Columns of a tile, bytes of C that a task accumulates in a scan, and of a factor sent to tasks.
BLOCK, STRIPE_BYTES, FACTOR_BYTES = 1024, 256 << 20, 256 << 20
_TILE = "kind string, i long, jb int, row array<double>"
_FACTOR = "idx long, w array<double>"


def widths(df: DataFrame, q_col: str, a_col: str) -> tuple[int, int]:
    got = df.select(F.size(q_col).alias("q"), F.size(a_col).alias("a")).first()
    if got is None:
        raise ValueError("no rows to fit on")
    return got["q"], got["a"]


def _vector_sum(c: str | Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(c)))


def gram_tiles(df: DataFrame, q_col: str, a_col: str, block: int = BLOCK, stripe_bytes: int | None = None) -> DataFrame:
    """Sums over all rows as ``(kind, i, jb, row)``: ``qa`` row i of ``sum q a^T``, columns
    from ``jb * block``; ``qq`` / ``aa`` the diagonals of both auto-sums (i = 0); ``n`` the row count."""
    d_q, d_a = widths(df, q_col, a_col)
    stripe = max(1, (stripe_bytes or STRIPE_BYTES) // (8 * d_a))

    def cut(kind: str, first: int, m: np.ndarray) -> Iterator[pd.DataFrame]:
        for jb in range(-(-m.shape[1] // block)):
            part = m[:, jb * block:(jb + 1) * block]
            yield pd.DataFrame({"kind": kind, "i": np.arange(first, first + len(m)), "jb": jb, "row": list(part)})

    def fold(low: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = n = 0
            qq, aa = np.zeros((1, d_q)), np.zeros((1, d_a))
            for b in batches:
                if len(b):
                    q, a = SC._matrix(b[q_col]), SC._matrix(b[a_col])
                    c = c + q[:, low:low + stripe].T @ a
                    n += len(b)
                    if low == 0:
                        qq += (q * q).sum(axis=0)
                        aa += (a * a).sum(axis=0)
            if n:
                yield from cut("qa", low, c)
                if low == 0:
                    for kind, m in (("qq", qq), ("aa", aa), ("n", np.array([[float(n)]]))):
                        yield from cut(kind, 0, m)
        return run

    # One partial per core, however many splits the input has.
    rows = df.select(q_col, a_col).coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    out = None
    for low in range(0, d_q, stripe):
        part = rows.mapInPandas(fold(low), _TILE)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "i", "jb").agg(_vector_sum("row").alias("row"))


def _weights(tiles: DataFrame, kind: str, n: float) -> DataFrame:
    """``(jb, wt)``: whitening weights ``1 / (sqrt(c) n)`` in blocks; a dead dimension gets weight 0."""
    wt = F.transform("row", lambda c: F.when(c > 0, 1 / (F.sqrt(c) * n)).otherwise(F.lit(0.0)))
    return tiles.where(F.col("kind") == kind).select("jb", wt.alias("wt"))


def _times(white: DataFrame, factor: DataFrame, block: int, blocks: int, transposed: bool) -> DataFrame:
    """``T`` (or ``T^T``) times a factor table ``(idx, w)``: a task per tile, a sum per index.
    ``blocks``: how many tiles the factor's block meets."""
    here, other = ("ib", "jb") if transposed else ("jb", "ib")
    f = (factor.select("idx", "w").withColumn(here, F.floor(F.col("idx") / block).cast("int"))
         .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def tile(key: tuple, t: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if t.empty or w.empty:
            return pd.DataFrame({"idx": [], "w": []})
        m, x = SC._matrix(t["row"]), SC._matrix(w["w"])
        at = w["idx"].to_numpy() - key[0 if transposed else 1] * block
        if transposed:
            full = np.zeros((block, x.shape[1]))
            full[at] = x
            out = m.T @ full[t["i"].to_numpy() - key[0] * block]
            return pd.DataFrame({"idx": key[1] * block + np.arange(len(out)), "w": list(out)})
        return pd.DataFrame({"idx": t["i"].to_numpy(), "w": list(m[:, at] @ x)})

    met = white.groupBy("ib", "jb").cogroup(f.groupBy("ib", "jb")).applyInPandas(tile, _FACTOR)
    return materialize(met.groupBy("idx").agg(_vector_sum("w").alias("w")), "wide-factor")


def _basis(factor: DataFrame, r: int) -> DataFrame:
    """An orthonormal basis of the factor's columns; the second turn removes the rounding of the first."""
    once = materialize(SC._orthonormal(factor, r), "wide-basis")
    first = once.first()
    return materialize(SC._orthonormal(once, len(first["w"])), "wide-basis") if first else once


def fit(df: DataFrame, q_col: str, a_col: str, k: int | None = None, block: int = BLOCK, oversample: int = 10,
        tol: float = 1e-9, max_rounds: int = 30, seed: int = 0) -> tuple[DataFrame, np.ndarray, int]:
    """One-stage CCA of any width: the model ``(side, idx, w)``, the ``k`` leading
    singular values (all, if None) and the rounds taken. Rounds end when no value
    changes by more than ``tol`` of the largest. Directions without correlation are left out."""
    d_q, d_a = widths(df, q_col, a_col)
    tiles = materialize(gram_tiles(df, q_col, a_col, block), "wide-gram")
    n = tiles.where(F.col("kind") == "n").first()["row"][0]
    wq, wa = _weights(tiles, "qq", n), _weights(tiles, "aa", n)
    one = F.element_at(F.col("q.wt"), (F.col("t.i") % block + 1).cast("int"))
    white = materialize(
        tiles.where(F.col("kind") == "qa").withColumn("ib", F.floor(F.col("i") / block).cast("int")).alias("t")
        .join(wq.alias("q"), F.col("t.ib") == F.col("q.jb")).join(wa.alias("a"), F.col("t.jb") == F.col("a.jb"))
        .select("t.ib", "t.jb", "t.i", F.zip_with("t.row", "a.wt", lambda c, w: c * w * one / n).alias("row")), "wide-white")
    n_q, n_a = -(-d_q // block), -(-d_a // block)
    r = min(d_q, d_a, (k if k is not None else min(d_q, d_a)) + oversample)

    start = F.array(*[F.randn(seed + j) for j in range(r)])
    basis = materialize(df.sparkSession.range(d_a).select(F.col("id").alias("idx"), start.alias("w")), "wide-start")
    basis, s, turn, rounds = _basis(basis, r), np.zeros(0), np.zeros((0, 0)), 0
    while True:
        # Rayleigh-Ritz: T basis = left; its Gram matrix holds the values and turns both sides.
        left = _times(white, basis, block, n_q, False)
        first = left.first()
        width = len(first["w"]) if first else 0
        value, vector = np.linalg.eigh(SC._gram(left, width))
        order = np.argsort(-value)
        now = np.sqrt(np.maximum(value[order], 0.0))[:k]
        rounds += 1
        done = len(now) == len(s) and np.abs(now - s).max(initial=0.0) <= tol * now.max(initial=0.0)
        s, turn = now, vector[:, order[:len(now)]]
        # A basis of the whole space has nothing to gain from another round.
        if done or width == d_a or rounds >= max_rounds or not s.max(initial=0.0) > 0:
            break
        basis = _basis(_times(white, _basis(left, width), block, n_a, True), width)
    live = s > s.max(initial=0.0) * 1e-7
    s, turn = s[live], turn[:, live]

    def side(name: str, factor: DataFrame, m: np.ndarray, weight: DataFrame) -> DataFrame:
        rows = SC._apply(factor, m).withColumn("jb", F.floor(F.col("idx") / block).cast("int")).join(weight, "jb")
        wt = F.element_at("wt", (F.col("idx") % block + 1).cast("int"))
        return rows.select(F.lit(name).alias("side"), "idx", F.transform("w", lambda x: x * wt).alias("w"))

    model = side("q", left, turn / s, wq).unionByName(side("a", basis, turn, wa))
    return materialize(model, "wide-model"), s, rounds


def project(df: DataFrame, col: str, model: DataFrame, sides: tuple[str, ...], id_col: str, out: str) -> DataFrame:
    """``(id_col, out)``: the vector in ``col`` times the factors of ``sides``, one after the
    other. Factors of up to ``FACTOR_BYTES`` are sent to the tasks; larger ones meet
    the entries of the vectors in a join on the index. ``id_col`` tells the rows apart."""
    held = materialize(model.where(F.col("side").isin(*sides)).select("side", "idx", "w"), "wide-model")
    if (held.agg(F.sum(F.size("w") * 8 + 16)).first()[0] or 0) > FACTOR_BYTES:
        entry = df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"), col)
        entry = entry.select("row_id", "side", F.posexplode(col).alias("idx", "cnt")).where(F.col("cnt") != 0)
        got = SC.project_rows(entry, held).groupBy("row_id").pivot("side", list(sides)).agg(F.first("vec"))
        width = held.select(F.size("w").alias("d")).first()["d"]
        zeros = F.array_repeat(F.lit(0.0), width)
        whole = F.concat(*[F.coalesce(F.col(s), zeros) for s in sides])
        return (df.select(id_col).join(got.withColumnRenamed("row_id", id_col), id_col, "left")
                .select(id_col, whole.alias(out)))
    parts: dict[str, list] = {s: [] for s in sides}
    for x in held.toLocalIterator():
        parts[x["side"]].append((x["idx"], x["w"]))
    factors = [(np.array([i for i, _ in parts[s]]), np.array([w for _, w in parts[s]])) for s in sides]
    sent = df.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = SC._matrix(b[col]) if len(b) else None
            y = [] if x is None else list(np.hstack([x[:, at] @ w for at, w in sent.value]))
            yield pd.DataFrame({id_col: b[id_col], out: y})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, col).mapInPandas(run, f"`{id_col}` {kind}, `{out}` array<double>")


def fit_two_stage(df: DataFrame, id_col: str, q_col: str, a_col: str, para: DataFrame, k: int | None = None,
                  **options) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Questions mapped to ``[q P1, q P2]`` by a paraphrase model, then CCA with the answers:
    the mapped rows ``(id_col, q_col)``, the model over them and the singular values."""
    z = materialize(project(df, q_col, para, ("q", "a"), id_col, q_col), "wide-mapped")
    model, s, _ = fit(z.join(df.select(id_col, a_col), id_col), q_col, a_col, k, **options)
    return z, model, s


def score(df: DataFrame, id_col: str, q_col: str, a_col: str, model: DataFrame, para: DataFrame | None = None) -> DataFrame:
    """``(id_col, dist)``: cosine distance of the projected sides; with ``para``, of
    questions mapped by it first."""
    z = df.select(id_col, q_col) if para is None else project(df, q_col, para, ("q", "a"), id_col, q_col)
    q = project(z, q_col, model, ("q",), id_col, "pq")
    a = project(df, a_col, model, ("a",), id_col, "pa")
    return q.join(a, id_col).select(id_col, cosine_distance("pq", "pa").alias("dist"))
