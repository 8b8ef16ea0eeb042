"""Embedding whitening (operator 11).

Vectors of whole numbers are projected on the leading components of their
covariance and scaled to variance 1. Three passes over the table: the first sums
the dimensions exactly, the second adds up the products of centred vectors, a
partial sum in each task, the third projects with the components, which are sent
to every task (``k`` rows as wide as a vector). The driver holds one matrix of
at most ``MAX_WIDTH`` squared numbers and decomposes it (``symmetric_eigen``):
Householder reflections, Sturm counts, inverse iteration.

Defined results: rows take no part whose vector is null, empty, not as long as
most (the longer of equally frequent lengths counts), or holds an entry that is
null, not finite or of magnitude ``TOP`` or more. Rows with a null id, repeated rows and extra columns
stay. Components without variance (beyond rounding) are left out, so equal vectors,
and a table without a valid vector, give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns
from qaspark.llm.symmetric_eigen import leading_eigenpairs

#: Widest vectors: the driver holds their covariance.
MAX_WIDTH = 4096
#: Magnitude from which an entry is not used.
TOP = float(1 << 30)


@dataclass
class Whitening:
    """What is learned: ``n`` vectors with sums ``sums`` (exact), components (rows)
    with falling eigenvalues, and the trace of the covariance."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        """Whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """``sums - n base``."""
        return [s - self.n * int(b) for s, b in zip(self.sums, self.base, strict=True)]


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """``floor(scale c) + shift`` of each entry ``c``, taken as a double; null for a
    vector that is null or holds a null, non-finite or too large entry."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < TOP), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift))


def usable(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is as long as most."""
    held = rows.where(F.coalesce(F.size(column), F.lit(0)) > 0)
    most = held.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return held
    if most["d"] > MAX_WIDTH:
        raise ValueError(f"vectors of {most['d']} entries; at most {MAX_WIDTH} are possible")
    return held.where(F.size(column) == most["d"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)


def sums_of(rows: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _matrices(batches):
            n, s = n + len(x), x.sum(axis=0)
            total = s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(-1, len(total), dtype=np.int32), "s": np.array([n, *total.tolist()])})

    # A row for each dimension.
    got = (rows.select(column).mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect())
    return (got[0]["s"], [r["s"] for r in got[1:]]) if got else (0, [])


def centred_products(rows: DataFrame, column: str, n: int, sums: list[int]) -> np.ndarray:
    """Sum over all vectors of the products of their centred entries."""
    model = Whitening(n, sums, np.empty(0), np.empty(0), 0.0)
    base, part = model.base, np.array([r / n for r in model.rest])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(base), len(base)))
        for x in _matrices(batches):
            y = (x - base) - part
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(base), dtype=np.int32), "row": total.tolist()})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_list()), axis=0)]})

    # One partial sum a core, however many splits the table has.
    few = rows.select(column).coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    got = (few.mapInArrow(multiply, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
           .orderBy("i").collect())  # a row for each dimension
    return np.array([r["row"] for r in got])


def fit(rows: DataFrame, column: str, k: int = 8) -> Whitening | None:
    """The whitening of the vectors of whole numbers in ``column`` (all of equal
    length); None without a vector."""
    n, sums = sums_of(rows, column)
    if not n:
        return None
    v = centred_products(rows, column, n, sums) / n
    values, components = leading_eigenpairs((v + v.T) / 2, k)
    trace = float(np.trace(v))
    live = values > max(trace, 0.0) * len(sums) * np.finfo(float).eps * 8
    return Whitening(n, sums, components[live], values[live], trace)


def apply(rows: DataFrame, model: Whitening, column: str) -> DataFrame:
    """``rows`` with ``deviation``, the exact sum over the dimensions of
    ``(n x - sums)^2`` (null where a long cannot hold it), and ``whitened``
    (array<double>); they replace columns of those names."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def project(vectors: pd.Series) -> pd.DataFrame:
        m = sent.value
        u = np.stack(vectors.to_list()) - m.base
        # n x - sums = n u - rest with small u: only sums of products of small numbers.
        rest = m.rest
        if max(int(np.abs(u).max()), *map(abs, rest)) ** 2 * len(rest) >= 1 << 62:
            u = u.astype(object)  # Python integers
        aa, ab = (u * u).sum(axis=1), u @ np.array(rest, u.dtype)
        cc = sum(r * r for r in rest)
        dev = [m.n * m.n * a - 2 * m.n * b + cc for a, b in zip(aa.tolist(), ab.tolist(), strict=True)]
        w = (u.astype(np.float64) - np.array([r / m.n for r in rest])) @ (m.components / np.sqrt(m.values)[:, None]).T
        return pd.DataFrame({"deviation": pd.array([x if x < 1 << 63 else None for x in dev], "Int64"), "whitened": list(w)})

    return add_columns(rows, [column], project, "deviation long, whitened array<double>", rows=4096)


def identity_error(rows: DataFrame, k: int, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of the whitened vectors, centred
    before multiplying, minus the identity."""
    w = [F.get(column, i) for i in range(k)]
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = rows.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, cov, strict=True))
