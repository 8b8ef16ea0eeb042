"""CCA over sparse n-gram count features (widths of 10^4 - 10^6 and more).

The whitened cross-covariance ``T = Wq Q^T A Wa`` (Q, A: sparse row x
vocabulary counts, W: inverse square roots of the diagonal auto-covariances)
is never formed. Its top-k singular triplets come from a randomized range
finder (Halko, Martinsson & Tropp, 2011). Rows are dealt to chunks of some
``CHUNK`` entries, written once with the indices that each chunk uses. A product
with ``T`` or ``T^T`` joins those indices, not the entries, with a table ``idx ->
r-vector``, multiplies within each chunk and sums the chunks' vectors by index.
The chunks and every factor are tables; the driver holds r x r Gram matrices only
(r = k + oversampling), which also give the orthonormal bases.

The second stage maps a question to ``z = [q P1, q P2]`` with the factors of a
paraphrase model and correlates z with the answers. ``P^T C_qq P`` is never formed from a
Gram matrix: its diagonal ``p_j^T C_qq p_j`` is the sum of ``z_j^2`` over the rows, and the whitened
``T' = W' (P^T C_qa) Wa`` has only as many rows as z is wide, so its left side is a small Gram
matrix and its right side a table over the answer vocabulary. A model is a table ``(side,
idx, w)``; a two-stage question side is the product of both question factors, so
rows are projected and scored alike for either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions.vector import cosine_distance
from qaspark.session import materialize


#: Entries of a chunk of rows, about, and the vectors that a task gathers before it adds them up by index.
CHUNK = 1 << 20
GATHER = 1 << 17

_SIDE = "{0}_idx array<long>, {0}_row binary, {0}_place binary, {0}_cnt binary"


def _times(entries: DataFrame, by: str, factor: DataFrame, to: str) -> DataFrame:
    """Sum over entries of ``cnt * factor[by]`` per ``to``: ``(to, w)``."""
    j = entries.join(factor, by)
    scaled = F.transform("w", lambda x: x * F.col("cnt"))
    return j.groupBy(to).agg(vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("w"))


def _counts(features: DataFrame) -> DataFrame:
    return materialize(features.select("row_id", "side", F.col("idx").cast("long").alias("idx"),
                                       F.col("cnt").cast("double").alias("cnt")), "sparse-counts")


def _weights(counts: DataFrame, n: float) -> DataFrame:
    """Inverse square roots of the diagonal auto-covariances (with the factor 1 / n of the dense form)."""
    return materialize(counts.groupBy("side", "idx").agg((1 / (F.sqrt(F.sum(F.col("cnt") ** 2)) * n)).alias("wt")), "sparse-weights")


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's entries as one row: for each side the indices in use and, for each entry, its row's number, its
    index's place and its count. Rows that lack a side add nothing to a product and are left out."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held)
    row = t["row_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int32)
    sides = {s: pc.equal(t["side"], s).to_numpy() for s in ("q", "a")}
    both = np.logical_and(*[np.bincount(row[at], minlength=row.max() + 1) > 0 for at in sides.values()])
    number = np.cumsum(both, dtype=np.int32) - 1
    idx, cnt = t["idx"].to_numpy(), t["cnt"].to_numpy()
    out = {"chunk": t["chunk"].combine_chunks()[:1], "rows": pa.array([int(both.sum())], pa.int32())}
    for s, at in sides.items():
        at = np.flatnonzero(at & both[row])
        own, place = np.unique(idx[at], return_inverse=True)
        out[f"{s}_idx"] = pa.array([own], pa.list_(pa.int64()))
        for name, x in (("row", number[row[at]]), ("place", place.astype(np.int32)), ("cnt", cnt[at])):
            out[f"{s}_{name}"] = pa.array([x.tobytes()], pa.binary())
    yield pa.RecordBatch.from_pydict(out)


def _chunks(white: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``white`` in chunks, and ``(chunk, side, idx, place)``, the indices that each chunk uses."""
    n = max(1, -(-white.count() // CHUNK))
    dealt = (white.where(F.col("row_id").isNotNull() & F.col("side").isin("q", "a"))
             .select(F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int").alias("chunk"), "row_id", "side", "idx", "cnt"))
    schema = ", ".join(["chunk int, rows int", *[_SIDE.format(s) for s in ("q", "a")]])
    chunks = materialize(dealt.repartitionById(n, F.col("chunk")).mapInArrow(_chunk, schema), "sparse-chunks")
    used = [chunks.select("chunk", F.lit(s).alias("side"), F.posexplode(f"{s}_idx").alias("place", "idx")) for s in ("q", "a")]
    return chunks, materialize(used[0].unionByName(used[1]), "sparse-places")


def _chunk_times(chunks: DataFrame, places: DataFrame, factor: DataFrame, by: str, to: str, n: float) -> DataFrame:
    """The entries of side ``to``, transposed, times those of side ``by`` times ``factor``, over ``n``: ``(idx, w)``."""
    def run(data: pa.Table, given: pa.Table) -> pa.Table:
        if not len(data) or not len(given):
            return pa.table({"idx": pa.array([], pa.int64()), "w": pa.array([], pa.list_(pa.float64()))})
        have = {c: np.frombuffer(data[c][0].as_buffer(), np.float64 if c.endswith("cnt") else np.int32)
                for c in data.column_names if c[2:] in ("row", "place", "cnt")}
        rows, idx = data["rows"][0].as_py(), data[f"{to}_idx"].combine_chunks().flatten()
        vectors = given["w"].combine_chunks().flatten().to_numpy().reshape(len(given), -1)
        m = np.zeros((len(data[f"{by}_idx"][0]), vectors.shape[1]))
        m[given["place"].to_numpy()] = vectors
        out = np.empty((len(idx), m.shape[1]))
        for j in range(m.shape[1]):
            v = np.bincount(have[f"{by}_row"], m[have[f"{by}_place"], j] * have[f"{by}_cnt"], rows)
            out[:, j] = np.bincount(have[f"{to}_place"], v[have[f"{to}_row"]] * have[f"{to}_cnt"], len(idx)) / n
        ends = pa.array(np.arange(len(idx) + 1, dtype=np.int32) * m.shape[1])
        return pa.table({"idx": idx, "w": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})

    given = places.where(F.col("side") == by).join(factor, "idx").select("chunk", "place", "w")
    parts = chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(run, "idx long, w array<double>")
    return parts.repartition(F.col("idx")).mapInArrow(_sums, "idx long, w array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each index added up; a task holds one vector an index and some more."""
    idx, w, held = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(idx), return_inverse=True)
        rows = np.concatenate(w)
        return own, np.stack([np.bincount(at, x, len(own)) for x in rows.T], axis=1)

    for b in batches:
        if len(b):
            idx.append(b.column(0).to_numpy())
            w.append(b.column(1).flatten().to_numpy().reshape(len(b), -1))
            held += len(b)
        if held >= GATHER:
            own, rows = added()
            idx, w, held = [own], [rows], 0
    if idx:
        own, rows = added()
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * rows.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["idx", "w"])


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s])


def _gram(factor: DataFrame, r: int) -> np.ndarray:
    """``M^T M`` of a factor table, an r x r matrix."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((r, r))
        for b in batches:
            if len(b):
                m = _matrix(b["w"])
                g += m.T @ m
        yield pd.DataFrame({"i": range(r), "row": list(g)})

    rows = (factor.select("w").mapInPandas(partial, "i int, row array<double>")
            .groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect())
    return np.array([x["row"] for x in sorted(rows, key=lambda x: x["i"])])


def _apply(factor: DataFrame, m: np.ndarray) -> DataFrame:
    """Each row vector times ``m``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(w=list(_matrix(b["w"]) @ m) if len(b) else [])

    return factor.select("idx", "w").mapInPandas(run, "idx long, w array<double>")


def _orthonormal(factor: DataFrame, r: int) -> DataFrame:
    """A basis of the factor's columns, from the eigenvectors of its Gram matrix;
    directions without weight are dropped."""
    value, vector = np.linalg.eigh(_gram(factor, r))
    live = value > max(value.max(), 0) * 1e-14
    return _apply(factor, vector[:, live] / np.sqrt(value[live]))


def sparse_factors(features: DataFrame, k: int = 100, oversample: int = 10, power_iters: int = 2,
                   seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``features``: long ``(row_id, side, idx, cnt)`` with sides ``q`` / ``a``.
    Returns the projections as a table ``(side, idx, w)`` and the singular values."""
    f = _counts(features)
    n = float(f.select("row_id").distinct().count())
    weight = _weights(f, n)
    widths = {x["side"]: x["n"] for x in weight.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    r = min(k + oversample, widths.get("q", 0), widths.get("a", 0))
    if not r:
        raise ValueError("both sides need a feature")
    white = materialize(f.join(weight, ["side", "idx"]).select("row_id", "side", "idx", (F.col("cnt") * F.col("wt")).alias("cnt")), "sparse-white")
    chunks, places = _chunks(white)

    def t_times(m_a: DataFrame) -> DataFrame:
        return materialize(_chunk_times(chunks, places, m_a, "a", "q", n), "sparse-factor")

    def tt_times(m_q: DataFrame) -> DataFrame:
        return materialize(_chunk_times(chunks, places, m_q, "q", "a", n), "sparse-factor")

    start = F.array(*[F.randn(seed + i) for i in range(r)])
    y = t_times(materialize(weight.where(F.col("side") == "a").select("idx", start.alias("w")), "sparse-start"))
    for _ in range(power_iters):
        y = t_times(tt_times(materialize(_orthonormal(y, r), "sparse-basis")))
    basis = materialize(_orthonormal(y, r), "sparse-basis")
    b = tt_times(basis)  # width_a x r: T^T basis
    value, vector = np.linalg.eigh(_gram(b, len(b.first()["w"])))
    order = np.argsort(-value)[:k]
    s = np.sqrt(np.maximum(value[order], 0.0))
    s, order = s[s > 0], order[:int((s > 0).sum())]
    u = vector[:, order]

    def project(factor: DataFrame, m: np.ndarray, side: str) -> DataFrame:
        scaled = F.transform("w", lambda x: x * F.col("wt"))
        return (_apply(factor, m).join(weight.where(F.col("side") == side), "idx")
                .select("side", "idx", scaled.alias("w")))

    return materialize(project(basis, u, "q").unionByName(project(b, u / s, "a")), "sparse-model"), s


def fit_sparse(features: DataFrame, k: int = 100, oversample: int = 10, power_iters: int = 2,
               seed: int = 0) -> DataFrame:
    """The projections in long form ``(side, i, k, w)``."""
    model, _ = sparse_factors(features, k, oversample, power_iters, seed)
    return model.select("side", F.col("idx").cast("int").alias("i"), F.posexplode("w").alias("k", "w"))


def question_map(para: DataFrame) -> DataFrame:
    """``(idx, w)`` with ``w = [P1, P2]`` of a paraphrase model whose two sides share the
    question vocabulary; an index that one side lacks has zeros there."""
    sides = [para.where(F.col("side") == s).select("idx", F.col("w").alias(f"w{s}")) for s in ("q", "a")]
    width = para.select(F.size("w").alias("d")).first()["d"]
    zeros = F.array_repeat(F.lit(0.0), width)
    both = sides[0].join(sides[1], "idx", "full")
    return materialize(both.select("idx", F.concat(F.coalesce("wq", zeros), F.coalesce("wa", zeros)).alias("w")), "sparse-map")


def two_stage_factors(features: DataFrame, mapped: DataFrame, k: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """CCA of the mapped questions with the answers. ``features`` as for
    :func:`sparse_factors`; ``mapped``: :func:`question_map`. Returns the answer factors
    ``(side, idx, w)``, the matrix of the question side (as many rows as ``mapped`` is wide) and the
    singular values."""
    f = _counts(features)
    n = float(f.select("row_id").distinct().count())
    q, a = (f.where(F.col("side") == s).drop("side") for s in ("q", "a"))
    rows = materialize(_times(q, "idx", mapped, "row_id"), "sparse-rows")
    first = mapped.select(F.size("w").alias("d")).first()
    if first is None or rows.isEmpty():
        raise ValueError("no question has a mapped feature")
    r = first["d"]
    diag = np.diagonal(_gram(rows, r)).copy()
    wq = np.zeros(r)
    wq[diag > 0] = 1 / (np.sqrt(diag[diag > 0]) * n)  # a dead dimension gets weight 0
    weight = _weights(f.where(F.col("side") == "a"), n).drop("side")
    # Columns of T': a vector of r numbers for each answer index.
    cross = _times(a, "row_id", rows, "idx").join(weight, "idx")
    columns = materialize(_apply(cross.select("idx", F.transform("w", lambda x: x * F.col("wt") / n).alias("w")), np.diag(wq)), "sparse-columns")
    value, vector = np.linalg.eigh(_gram(columns, r))
    order = np.argsort(-value)[:k]
    order = order[value[order] > max(value.max(), 0) * 1e-14]
    s, u = np.sqrt(value[order]), vector[:, order]
    scaled = F.transform("w", lambda x: x * F.col("wt"))
    answers = _apply(columns, u / s).join(weight, "idx").select(F.lit("a").alias("side"), "idx", scaled.alias("w"))
    return materialize(answers, "sparse-answers"), wq[:, None] * u, s


def two_stage_model(features: DataFrame, mapped: DataFrame, k: int | None = None) -> DataFrame:
    """The two-stage model as one table ``(side, idx, w)`` over question and answer
    indices: the question side is ``[P1, P2] Q``."""
    answers, q, _ = two_stage_factors(features, mapped, k)
    return materialize(_apply(mapped, q).select(F.lit("q").alias("side"), "idx", "w").unionByName(answers), "sparse-model")


def project_rows(features: DataFrame, model: DataFrame) -> DataFrame:
    """``(row_id, side, vec)``: the counts of each row and side times the model's
    factors - a join on the index, split by AQE where one is hot, and a sum a row."""
    held = materialize(model.select("side", "idx", "w"), "sparse-model")
    scaled = F.transform("w", lambda x: x * F.col("cnt"))
    return (features.select("row_id", "side", F.col("idx").cast("long").alias("idx"), "cnt").join(held, ["side", "idx"])
            .groupBy("row_id", "side").agg(vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("vec")))


def score(features: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """``(row_id, dist)``: cosine distance of the projected sides of each row of
    ``features``; without a model, of the counts themselves. A row with a side without a
    known feature has no distance."""
    rows = features.select("row_id").distinct()
    if model is None:
        q, a = (features.where(F.col("side") == s).select("row_id", "idx", F.col("cnt").alias(s)) for s in ("q", "a"))
        sums = (q.join(a, ["row_id", "idx"], "full").groupBy("row_id")
                .agg(F.sum(F.col("q") * F.col("a")).alias("dot"), F.sum(F.col("q") ** 2).alias("qq"), F.sum(F.col("a") ** 2).alias("aa")))
        dist = 1 - F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.col("qq")) / F.sqrt(F.col("aa"))
        return sums.select("row_id", dist.alias("dist"))
    v = project_rows(features, model).groupBy("row_id").pivot("side", ["q", "a"]).agg(F.first("vec"))
    return rows.join(v.select("row_id", cosine_distance("q", "a").alias("dist")), "row_id", "left")
