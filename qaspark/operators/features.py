"""Representations and features of question/answer rows of any data set.

Rows carry token-array columns; ``sides`` maps a side name to its column. The
vocabulary is an input, so that a test set is indexed and counted with the
vocabulary of its training set.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from qaspark.functions import text as T
from qaspark.operators import holographic as H
from qaspark.operators import vectors as VEC
from qaspark.operators import vocab as VO
from qaspark.session import materialize

NGRAM_KINDS = {"unigram": 1, "bigram": 2, "trigram": 3}
KINDS = (*NGRAM_KINDS, "avg", "holographic")


def _gather(long: DataFrame, rows: DataFrame, id_col: str, sides: dict, value: str) -> DataFrame:
    """Long ``(row_id, side, pos, value)`` back to one array column per side;
    rows and sides without tokens get an empty array."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", value)))
    g = long.groupBy("row_id", "side").agg(F.transform(pairs, lambda x: x[value]).alias("v"))
    wide = g.groupBy("row_id").agg(*[F.max_by("v", F.col("side") == s).alias(f"_{s}") for s in sides],
                                   *[F.max((F.col("side") == s).cast("int")).alias(f"_has_{s}") for s in sides])
    kind = long.schema[value].dataType.simpleString()
    out = rows.join(wide.withColumnRenamed("row_id", id_col), id_col, "left")
    for s, c in sides.items():
        empty = F.array().cast(f"array<{kind}>")
        out = out.withColumn(c, F.when(F.col(f"_has_{s}") == 1, F.col(f"_{s}")).otherwise(empty))
    return out.drop(*[f"_{s}" for s in sides], *[f"_has_{s}" for s in sides])


def as_indices(rows: DataFrame, sides: dict, vocab: DataFrame, id_col: str = "row_id", unique: bool = False) -> DataFrame:
    """Token arrays replaced by vocabulary indices (UNKNOWN where absent). A vocabulary that can be sent to the
    tasks is looked up in place; a larger one meets the tokens in a join. Rows that share an id are
    represented together; ``unique``: no two do and none lacks one."""
    cols = [*[c for c in rows.columns if c not in sides.values()], *sides.values()]
    found = VO.lookup_indices(rows, sides, vocab)
    if found is None:
        long = VO.index_tokens(VO.side_tokens(rows, sides, id_col), vocab)
        return _gather(long, rows.drop(*sides.values()), id_col, sides, "idx")
    return found.select(*cols) if unique else together(found.select(*cols), sides, id_col)


def together(rows: DataFrame, sides: dict, id_col: str = "row_id") -> DataFrame:
    """Rows of index arrays; those that share an id are represented together."""
    own, shared = VEC.split_shared(materialize(rows, "indices"), [id_col])
    if shared is None:
        return own
    long = VO.side_tokens(shared, sides, id_col).withColumnRenamed("token", "idx")
    return own.unionByName(_gather(long, shared.drop(*sides.values()), id_col, sides, "idx"))


def as_vectors(rows: DataFrame, sides: dict, vectors: DataFrame, unknown: Sequence[float],
               id_col: str = "row_id") -> DataFrame:
    """Token arrays replaced by word vectors (the UNKNOWN vector where absent). Words meet
    their vectors where the row is (:func:`vectors.meet`); rows that share an id are represented together."""
    cols = [*[c for c in rows.columns if c not in sides.values()], *sides.values()]
    own, shared = VEC.split_shared(materialize(rows.select(*cols), "token-rows"), [id_col])
    out = StructType()
    for f in own.schema:
        out.add(f.name, ArrayType(ArrayType(DoubleType())) if f.name in sides.values() else f.dataType)

    def run(lookup: VEC.Lookup, batch: pa.RecordBatch) -> list:
        return [H.vectors_of(lookup, batch.column(c)) if c in sides.values() else batch.column(c) for c in cols]

    named = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in sides.values()])
    got = VEC.meet(own, named, vectors, unknown, run, out)
    if shared is None:
        return got
    long = VO.side_tokens(shared, sides, id_col).join(vectors, "token", "left")
    long = long.select("row_id", "side", "pos", F.coalesce("vec", H.V.literal(unknown)).alias("vec"))
    return got.unionByName(_gather(long, shared.drop(*sides.values()), id_col, sides, "vec"))


def sentence_text(col: str, mode: str):
    """Text form of a represented sentence: words or indices set apart by
    blanks; a vector as ``v|v|...``."""
    if mode == "embedding":
        return F.array_join(F.transform(col, lambda v: T.vec_to_text(v, "|")), " ")
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def featurize(rows: DataFrame, kind: str, sides: dict, id_col: str = "row_id", vocab: DataFrame | None = None,
              vectors: DataFrame | None = None, unknown: Sequence[float] | None = None,
              structure: dict | None = None) -> DataFrame:
    """Features of ``rows``.

    ``unigram/bigram/trigram``: sparse counts ``(row_id, side, idx, cnt)`` with the
    given vocabulary; question n-grams only, answers stay words. ``avg``: mean
    vectors ``(row_id, side, vec)``. ``holographic``: folds ``(row_id, side, vec)``;
    ``structure`` maps e1, r, e2 to the token columns of a structured answer."""
    if kind in NGRAM_KINDS:
        n = NGRAM_KINDS[kind]
        if n > 1:
            rows = rows.withColumn(sides["q"], T.ngrams(F.col(sides["q"]), n))
        return VO.ngram_counts(VO.index_tokens(VO.side_tokens(rows, sides, id_col), vocab))
    rows = rows.withColumnRenamed(id_col, "row_id")
    ids = ["row_id", "side"]
    if kind == "avg":
        return VEC.sentence_vectors(VEC.long_sides(rows, ["row_id"], sides), ids, "tokens", vectors, unknown)
    if kind != "holographic":
        raise ValueError(f"unknown feature {kind}")
    flat = {s: c for s, c in sides.items() if not (structure and s == "a")}
    out = H.sentence_holographic(VEC.long_sides(rows, ["row_id"], flat), ids, "tokens", vectors, unknown)
    if structure:
        answers = H.answer_holographic(rows, ["row_id"], structure, vectors, unknown)
        out = out.unionByName(answers.select("row_id", F.lit("a").alias("side"), "vec"))
    return out
