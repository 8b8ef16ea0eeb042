"""Canonical correlation between question and answer features.

Data work is one distributed aggregation: every partition folds its rows
into partial Gram sums with NumPy (one BLAS call per Arrow batch) inside
``mapInPandas``; partials are summed per Gram row by a JVM vector
aggregate. Only the d x d result (d = feature width, bounded) reaches the
driver, where the whitened cross-covariance is decomposed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.session import swept

MAX_WIDTH = 4096
_GRAM_SCHEMA = "kind string, i int, row array<double>"


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s]) if len(s) else np.zeros((0, 0))


def gram_table(df: DataFrame, q_col: str, a_col: str, full_qq: bool = False, masks: Sequence[str] = ()) -> DataFrame:
    """Sums over all rows as ``(kind, i, row)``: ``qa`` rows of sum q a^T,
    ``qq`` rows of sum q q^T (or one row, its diagonal), ``aa`` one row (the
    diagonal of sum a a^T), ``n`` the row count. With ``masks``, names of boolean columns,
    the same for the rows of each from the one scan, as kinds ``mask/qa`` and so on."""

    def partial(batches):
        acc = {}
        for pdf in batches:
            for mask in masks or ("",):
                rows = pdf[pdf[mask].to_numpy(dtype=bool)] if mask else pdf
                if len(rows) == 0:
                    continue
                q = _stack(rows[q_col])
                a = _stack(rows[a_col])
                parts = {"qa": q.T @ a, "qq": q.T @ q if full_qq else (q * q).sum(0)[None, :],
                         "aa": (a * a).sum(0)[None, :], "n": np.array([[float(len(q))]])}
                for kind, v in parts.items():
                    k = f"{mask}/{kind}" if mask else kind
                    acc[k] = acc[k] + v if k in acc else v
        rows = [(k, i, m[i].tolist()) for k, m in acc.items() for i in range(m.shape[0])]
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "i", "row"])

    # One partial per core, however many splits the input has, then a sum in
    # two steps: d rows of d numbers leave each task.
    cores = df.sparkSession.sparkContext.defaultParallelism
    part = df.select(q_col, a_col, *masks).coalesce(2 * cores).mapInPandas(partial, _GRAM_SCHEMA)
    return (part.groupBy("kind", "i")
            .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row")))


def _gather(df: DataFrame, q_col: str, a_col: str, full_qq: bool, masks: Sequence[str], sized: DataFrame | None = None) -> list:
    with swept(df.sparkSession):
        one = (df if sized is None else sized).select(F.greatest(F.size(q_col), F.size(a_col)).alias("d")).first()
        if one is not None and one["d"] > MAX_WIDTH:
            raise ValueError("feature width exceeds MAX_WIDTH; wide_cca.fit takes any width")
        return gram_table(df, q_col, a_col, full_qq, masks).collect()  # bounded: <= 2 d + 2 rows of <= d numbers a mask


def _sums(got: list, prefix: str = "") -> dict:
    out: dict[str, np.ndarray] = {}
    for kind in ("qa", "qq", "aa", "n"):
        rows = sorted((r["i"], r["row"]) for r in got if r["kind"] == prefix + kind)
        out[kind] = np.array([r for _, r in rows], dtype=np.float64) if rows else None
    out["n"] = float(out["n"][0, 0]) if out["n"] is not None else 0.0
    return out


def gram_sums(df: DataFrame, q_col: str, a_col: str, full_qq: bool = False) -> dict:
    """:func:`gram_table` gathered as NumPy matrices on the driver. The width is a
    model parameter of at most ``MAX_WIDTH``, read from one row beforehand."""
    return _sums(_gather(df, q_col, a_col, full_qq, ()))


def gram_sums_by(df: DataFrame, q_col: str, a_col: str, masks: Sequence[str], full_qq: bool = False,
                 sized: DataFrame | None = None) -> dict[str, dict]:
    """:func:`gram_sums` of the rows of each boolean column in ``masks``, from one scan. ``sized``: a table with
    vectors of the same width, where its first row costs less than that of ``df``."""
    got = _gather(df, q_col, a_col, full_qq, masks, sized)
    return {m: _sums(got, f"{m}/") for m in masks}


@dataclass
class CCAModel:
    q: np.ndarray          # d_q x k
    a: np.ndarray          # d_a x k
    s: np.ndarray          # singular values (canonical correlations up to scale)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """``(side, i, k, w)``; one row per matrix row, unfolded by Spark."""
        frame = [(side, i, row) for side, m in (("q", self.q), ("a", self.a)) for i, row in enumerate(m.tolist())]
        rows = spark.createDataFrame(frame, "side string, i int, row array<double>")
        return rows.select("side", "i", F.posexplode("row").alias("k", "w"))

    @staticmethod
    def from_df(model: DataFrame) -> "CCAModel":
        rows = model.toPandas()  # bounded by d x k per side
        def mat(side):
            r = rows[rows["side"] == side]
            m = np.zeros((r["i"].max() + 1, r["k"].max() + 1))
            m[r["i"], r["k"]] = r["w"]
            return m
        return CCAModel(mat("q"), mat("a"), np.array([]))


def _inv_sqrt(diag: np.ndarray) -> np.ndarray:
    """Diagonal whitening weights; a dead (zero) dimension gets weight 0."""
    out = np.zeros_like(diag)
    live = diag > 0
    out[live] = 1.0 / np.sqrt(diag[live])
    return out


def fit_from_grams(c_qa: np.ndarray, d_qq: np.ndarray, d_aa: np.ndarray, n: float, k: int | None = None) -> CCAModel:
    """``T = Dqq^-1/2 Cqa Daa^-1/2``, ``U s V^T = svd(T)``,
    ``Q_k = Dqq^-1/2 U``, ``A_k = Daa^-1/2 V``; only the diagonals of the
    auto-covariances are used."""
    wq = _inv_sqrt(d_qq) / n
    wa = _inv_sqrt(d_aa) / n
    t = (wq[:, None] * (c_qa / n)) * wa[None, :]
    u, s, vt = np.linalg.svd(t, full_matrices=False)
    if k is not None:
        u, s, vt = u[:, :k], s[:k], vt[:k]
    return CCAModel(wq[:, None] * u, wa[:, None] * vt.T, s)


def fit(df: DataFrame, q_col: str, a_col: str, k: int | None = None) -> CCAModel:
    """One-stage CCA over a ``(q vector, a vector)`` DataFrame."""
    g = gram_sums(df, q_col, a_col)
    return fit_from_grams(g["qa"], g["qq"][0], g["aa"][0], g["n"], k)


def fit_two_stage(df: DataFrame, q_col: str, a_col: str, para: CCAModel, k: int | None = None) -> CCAModel:
    """Two-stage CCA: questions first mapped to ``[q P1, q P2]`` by the
    paraphrase model. Derived from one Gram pass without re-scanning:
    ``diag(C_q'q')_j = p_j^T C_qq p_j`` and ``C_q'a = P^T C_qa``."""
    return two_stage_from_grams(gram_sums(df, q_col, a_col, full_qq=True), para, k)


def two_stage_from_grams(g: dict, para: CCAModel, k: int | None = None) -> CCAModel:
    p = np.hstack([para.q, para.a])
    d_qq = np.einsum("ij,ik,kj->j", p, g["qq"], p)
    return fit_from_grams(p.T @ g["qa"], d_qq, g["aa"][0], g["n"], k)


def project(df: DataFrame, col: str, mats: list[np.ndarray], out: str) -> DataFrame:
    """``out = [v M_1, v M_2, ...]`` (concatenated) for the vector column
    ``col``; the matrices go to executors once as a broadcast variable."""
    spark = df.sparkSession
    for m in mats:
        if max(m.shape) > MAX_WIDTH:
            raise ValueError("projection matrix exceeds MAX_WIDTH")
    bc = spark.sparkContext.broadcast([np.asarray(m, dtype=np.float64) for m in mats])
    fields = [f for f in df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != out)
    schema += f", `{out}` array<double>"

    def run(batches):
        ms = bc.value
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf[col])
                y = np.hstack([x @ m for m in ms])
                pdf[out] = list(y)
            else:
                pdf[out] = []
            yield pdf

    return df.mapInPandas(run, schema)


def score(qa: DataFrame, q_col: str, a_col: str, model: CCAModel | None = None,
          para: CCAModel | None = None) -> DataFrame:
    """Cosine distance after projection (0-stage: raw vectors; 1-stage:
    ``q Q_k`` vs ``a A_k``; 2-stage: ``[q P1, q P2] Q_k`` vs ``a A_k``)."""
    from qaspark.functions.vector import cosine_distance
    x = qa
    if model is not None:
        qm = model.q
        if para is not None:
            qm = np.hstack([para.q, para.a]) @ model.q
        x = project(project(x, q_col, [qm], "_pq"), a_col, [model.a], "_pa")
        return x.withColumn("dist", cosine_distance("_pq", "_pa")).drop("_pq", "_pa")
    return x.withColumn("dist", cosine_distance(q_col, a_col))
