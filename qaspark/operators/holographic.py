"""Holographic (circular-correlation) sentence features.

Native Column form for small widths and for the oracle-checked queries
(:func:`qaspark.functions.vector.fold_correlation`); the production path
folds with FFTs in a pandas UDF, O(d log d) per step instead of O(d^2).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from qaspark.functions import vector as V
from qaspark.operators import vectors as VEC
from qaspark.session import materialize


def cc_fft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``c_k = sum_i a_i b_{(k+i) mod d}``; an all-zero operand is the identity."""
    if not a.any():
        return b
    if not b.any():
        return a
    return np.fft.ifft(np.conj(np.fft.fft(a)) * np.fft.fft(b)).real


def fold_all(groups: list, d: int) -> np.ndarray:
    """Folds of many word lists at once, a row each. All words are transformed
    in one FFT and the folds advance together in the frequency domain
    (``acc = conj(acc) * F(v)``, zero vectors skipped), longest lists first."""
    live = [[v for v in (np.asarray(x, dtype=np.float64) for x in (g if g is not None else [])) if v.any()] for g in groups]
    n = np.array([len(g) for g in live], dtype=np.int64)
    if not n.sum():
        return np.zeros((len(groups), d))
    return _fold_spectra(np.fft.fft(np.stack([v for g in live for v in g]), axis=1), np.arange(n.sum()), n)


def _fold_spectra(spectra: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Folds of lists of ``n`` words each; ``at`` names the spectrum of each word, list by list."""
    out = np.zeros((len(n), spectra.shape[1]))
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return out
    acc = spectra[at[first[order]]]
    for step in range(1, int(n.max())):
        m = int((n[order] > step).sum())
        acc[:m] = np.conj(acc[:m]) * spectra[at[first[order[:m]] + step]]
    out[order] = np.fft.ifft(acc, axis=1).real
    return out


def _fold_rows(matrix: np.ndarray, live: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """:func:`fold_all` of lists of ``n`` rows of ``matrix`` each; every row is transformed once."""
    of = np.repeat(np.arange(len(n)), n)
    keep = live[rows]
    used, at = np.unique(rows[keep], return_inverse=True)
    if not len(used):
        return np.zeros((len(n), matrix.shape[1]))
    return _fold_spectra(np.fft.fft(matrix[used], axis=1), at, np.bincount(of[keep], minlength=len(n)))


def _list_rows(lookup: VEC.Lookup, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix rows of the words of each list, in order, and how many each list has."""
    rows, times = lookup.all_rows(tokens.flatten())
    of = np.repeat(np.arange(len(tokens)), VEC.list_lengths(tokens))
    return rows, np.bincount(of, weights=times, minlength=len(tokens)).astype(np.int64)


def vectors_of(lookup: VEC.Lookup, tokens: pa.ListArray) -> pa.ListArray:
    """The vectors of the words of each list."""
    rows, n = _list_rows(lookup, tokens)
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), VEC.vector_lists(lookup.matrix[rows]))


def _fold_lists(folds: np.ndarray) -> pa.ListArray:
    """Folds as an array of vectors; a number that overflowed away (NaN) is null, as a pandas UDF returns it."""
    ends = np.arange(len(folds) + 1, dtype=np.int32) * folds.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(folds.ravel(), pa.float64(), from_pandas=True))


def _folds(lookup: VEC.Lookup, tokens: pa.ListArray) -> np.ndarray:
    return _fold_rows(lookup.matrix, lookup.live, *_list_rows(lookup, tokens))


def fold_udf(d: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def fold(col: pd.Series) -> pd.Series:
        return pd.Series(list(fold_all(list(col), d)))
    return fold


def correlation_udf():
    """Circular correlation of two vector columns, FFT form."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def correlate(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cc_fft(np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)) for x, y in zip(a, b)])
    return correlate


def ordered_vectors(sentences: DataFrame, ids: Sequence[str], tokens_col: str, vectors: DataFrame,
                    unknown: Sequence[float]) -> DataFrame:
    """Word vectors of each sentence in word order ``(ids..., vecs)``; unseen
    words take the UNKNOWN vector. One group per sentence (bounded by its length)."""
    ids = list(ids)
    w = sentences.select(*ids, F.posexplode(tokens_col).alias("pos", "token"))
    j = w.join(vectors, "token", "left").select(
        *ids, "pos", F.coalesce(F.col("vec"), V.literal(unknown)).alias("vec"))
    g = j.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("pv"))
    return (sentences.select(*ids).join(g, ids, "left")
            .select(*ids, F.coalesce(F.transform("pv", lambda x: x["vec"]),
                                     F.array().cast("array<array<double>>")).alias("vecs")))


def _schema(df: DataFrame, ids: list[str]) -> StructType:
    return StructType([df.schema[c] for c in ids]).add("vec", ArrayType(DoubleType()))


def sentence_holographic(sentences: DataFrame, ids: Sequence[str], tokens_col: str, vectors: DataFrame,
                         unknown: Sequence[float]) -> DataFrame:
    """Flat fold of circular correlation over a sentence's word vectors, which meet the
    sentences in parts (:func:`vectors.meet`); the words of rows that share their ids are folded together."""
    ids = list(ids)
    held = materialize(sentences.select(*ids, F.col(tokens_col).alias("_tokens")), "sentences")
    own, shared = VEC.split_shared(held, ids)

    def run(lookup: VEC.Lookup, batch: pa.RecordBatch) -> list:
        return [*[batch.column(c) for c in ids], _fold_lists(_folds(lookup, batch.column("_tokens")))]

    out = VEC.meet(own, F.col("_tokens"), vectors, unknown, run, _schema(held, ids))
    if shared is None:
        return out
    ov = ordered_vectors(shared, ids, "_tokens", vectors, unknown)
    return out.unionByName(ov.select(*ids, fold_udf(len(unknown))("vecs").alias("vec")))


def _structure(e1: np.ndarray, r: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """``r * (e1 * e2)`` of folds, a row each."""
    d = e1.shape[1]
    return fold_all(list(zip(r, fold_all(list(zip(e1, e2)), d))), d)


def answer_holographic(answers: DataFrame, ids: Sequence[str], parts: dict, vectors: DataFrame,
                       unknown: Sequence[float]) -> DataFrame:
    """Structured answers: ``parts`` maps e1, r and e2 to token-array columns of
    any length; ``(ids, vec)`` with ``fold(r) * (fold(e1) * fold(e2))``, one row for rows that share their ids."""
    ids = list(ids)
    names = ("e1", "r", "e2")
    held = materialize(answers.select(*ids, *[F.col(parts[p]).alias(f"_{p}") for p in names]), "answers")
    own, shared = VEC.split_shared(held, ids)

    def run(lookup: VEC.Lookup, batch: pa.RecordBatch) -> list:
        e1, r, e2 = (_folds(lookup, batch.column(f"_{p}")) for p in names)
        return [*[batch.column(c) for c in ids], _fold_lists(_structure(e1, r, e2))]

    named = F.concat(*[F.coalesce(f"_{p}", F.array().cast("array<string>")) for p in names])
    out = VEC.meet(own, named, vectors, unknown, run, _schema(held, ids))
    if shared is None:
        return out
    ov = ordered_vectors(VEC.long_sides(shared, ids, {p: f"_{p}" for p in names}), [*ids, "side"], "tokens", vectors, unknown)
    wide = VEC.pivot_sides(ov, ids, {p: p for p in names}, vec_col="vecs")
    return out.unionByName(wide.select(*ids, structure_udf(len(unknown))(*names).alias("vec")))


def _levels(nodes: DataFrame, ids: list[str]) -> list[DataFrame]:
    """The nodes by nesting, outermost first; those not below a top item are left out. Joins are by sorting: the file of
    a level is some thirtieth of its rows in memory, so Spark would broadcast by it what the driver cannot hold."""
    level = materialize(nodes.where(F.col("parent").isNull()), "tree-0")
    out = []
    while not level.isEmpty():
        out.append(level)
        above = level.where(F.col("token").isNull()).select(*ids, F.col("node").alias("parent"))
        level = materialize(nodes.join(above.hint("merge"), [*ids, "parent"]), f"tree-{len(out)}")
    return out


def _fold_items(ids: list[str]):
    """Folds lists of items ``(ord, token, vec)``, in the order of ``ord`` and then of the
    vectors: a word by its vector, a list (no token) by its own fold."""
    def run(lookup: VEC.Lookup, batch: pa.RecordBatch) -> list:
        lists = batch.column("_items")
        item = lists.flatten()
        of = np.repeat(np.arange(len(lists)), VEC.list_lengths(lists))
        token, vec, place = (pc.struct_field(item, i) for i in (1, 2, 0))
        rows, times = lookup.all_rows(token)
        at = np.repeat(np.arange(len(item)), times)  # a token with several vectors counts with each
        matrix = lookup.matrix[rows]
        folds = np.flatnonzero(token.is_null().to_numpy(zero_copy_only=False))
        if len(folds):
            inner = vec.take(pa.array(folds)).flatten().to_numpy(zero_copy_only=False)
            matrix[np.isin(at, folds)] = inner.reshape(len(folds), -1)
        group, order = of[at], place.to_numpy(zero_copy_only=False)[at]
        by = np.lexsort((order, group))
        group, order = group[by], order[by]
        tied = (group[1:] == group[:-1]) & (order[1:] == order[:-1])
        for first in np.flatnonzero(tied & ~np.concatenate(([False], tied[:-1]))) if tied.any() else ():
            end = first + 1
            while end < len(by) and group[end] == group[first] and order[end] == order[first]:
                end += 1
            by[first:end] = sorted(by[first:end], key=lambda i: matrix[i].tolist())
        got = _fold_rows(matrix, (matrix != 0).any(axis=1), by, np.bincount(group, minlength=len(lists)))
        return [*[batch.column(c) for c in ids], _fold_lists(got)]
    return run


def fold_tree(sentences: DataFrame, nodes: DataFrame, ids: Sequence[str], vectors: DataFrame, unknown: Sequence[float]) -> DataFrame:
    """``(ids, vec)``: circular correlation folded over nested lists, any depth.

    ``nodes``: ``(ids, node, parent, ord, token)``, an item of a list each: a word (``token``)
    or, with a null token, a list of its own; ``parent`` is the list it stands in (null: the
    sentence's own list) and ``ord`` its place there. Lists are folded level by level from the
    innermost, all lists of a level at once; the items of one list meet in a group. An empty list counts as a zero vector and so for nothing, and a
    sentence without items is a zero vector."""
    ids = list(ids)
    items = nodes.select(*ids, "node", "parent", "ord", "token")
    folded = None
    for level in reversed(_levels(items, ids)):
        words = level.where(F.col("token").isNotNull()).select(
            *ids, "parent", "ord", "token", F.lit(None).cast("array<double>").alias("vec"))
        if folded is not None:
            lists = level.where(F.col("token").isNull()).drop("parent").join(
                folded.withColumnRenamed("parent", "node").hint("merge"), [*ids, "node"]).join(
                level.select(*ids, "node", "parent").hint("merge"), [*ids, "node"])
            words = words.unionByName(lists.select(*ids, "parent", "ord", "token", "vec"))
        groups = words.groupBy(*ids, "parent").agg(F.collect_list(F.struct("ord", "token", "vec")).alias("_items"))
        named = F.filter(F.transform("_items", lambda x: x["token"]), lambda t: t.isNotNull())
        folded = materialize(VEC.meet(materialize(groups, "tree-items"), named, vectors, unknown, _fold_items([*ids, "parent"]), _schema(groups, [*ids, "parent"])), "tree-fold")
    zero = V.literal([0.0] * len(unknown))
    if folded is None:
        return sentences.select(*ids, zero.alias("vec"))
    return sentences.select(*ids).join(folded.drop("parent").hint("merge"), ids, "left").select(*ids, F.coalesce("vec", zero).alias("vec"))


def structure_udf(d: int):
    """FFT form of ``fold(r) * (fold(e1) * fold(e2))`` over three arrays of vectors."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def structure(e1: pd.Series, r: pd.Series, e2: pd.Series) -> pd.Series:
        n = len(e1)
        f = fold_all([*e1, *e2, *r], d)
        ee = fold_all(list(zip(f[:n], f[n:2 * n])), d)
        return pd.Series(list(fold_all(list(zip(f[2 * n:], ee)), d)))
    return structure


def answer_structure(e1, r, e2, d: int):
    """``fold(r) * (fold(e1) * fold(e2))`` for arrays of vectors (native form)."""
    return V.circular_correlation(V.fold_correlation(r, d),
                                  V.circular_correlation(V.fold_correlation(e1, d),
                                                         V.fold_correlation(e2, d), d), d)
