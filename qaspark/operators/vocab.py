"""Vocabulary: token frequencies per side, frequent-token index, lookups, n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from qaspark.functions import text as T
from qaspark.operators.ranking import dense_rank_by
from qaspark.session import materialize

# FIXED VALUES - out-of-vocabulary token and its index.
UNKNOWN_TOKEN = "UNKNOWN"
UNKNOWN_INDEX = 0
# A token enters the vocabulary when it occurs more than this many times.
MIN_COUNT = 3
#: Bytes of a vocabulary sent to every task; a larger one meets the tokens in a join.
LOOKUP_BYTES = 16 << 20


def side_tokens(pairs: DataFrame, sides: dict[str, str], id_col: str = "row_id") -> DataFrame:
    """Token arrays per side -> long ``(row_id, side, pos, token)``, in one
    pass over ``pairs`` (no per-side branch recomputing the upstream)."""
    both = F.array(*[F.struct(F.lit(side).alias("side"), F.col(col).alias("toks")) for side, col in sides.items()])
    s = pairs.select(F.col(id_col).alias("row_id"), F.explode(both).alias("s"))
    return s.select("row_id", F.col("s.side").alias("side"), F.posexplode("s.toks").alias("pos", "token"))


def token_counts(tokens: DataFrame, by: tuple[str, ...] = ("side",)) -> DataFrame:
    return tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def sentence_tokens(texts: DataFrame, tokenizers: dict) -> DataFrame:
    """``(side, mult, toks)``: each distinct text of a side tokenised once, with how often it occurs,
    written once. ``texts`` has one column per side; ``tokenizers`` maps side ->
    (column, Column function text -> token array). One pass over ``texts``:
    sides are exploded together, repeated sentences pre-aggregated to
    (side, text, multiplicity) before the heavy normalisation."""
    both = F.array(*[F.struct(F.lit(side).alias("side"), F.col(col).alias("text"))
                     for side, (col, _) in tokenizers.items()])
    st = texts.select(F.explode(both).alias("s")).select("s.side", "s.text")
    distinct = st.groupBy("side", "text").agg(F.count(F.lit(1)).alias("mult"))
    tok = None
    for side, (_, fn) in tokenizers.items():
        e = fn(F.col("text"))
        tok = F.when(F.col("side") == side, e) if tok is None else tok.when(F.col("side") == side, e)
    # Token arrays of the distinct sentences are written once, so whoever
    # counts them reads them instead of re-running the normaliser.
    return materialize(distinct.select("side", "mult", tok.alias("toks")), "sentence-tokens")


def weighted_token_counts(sentences: DataFrame, grams: dict[str, int]) -> DataFrame:
    """``(side, token, count)`` of :func:`sentence_tokens`; ``grams`` gives the n-gram length of a side (1 if absent)."""
    toks = F.col("toks")
    for side, n in grams.items():
        if n > 1:
            toks = F.when(F.col("side") == side, T.ngrams(F.col("toks"), n)).otherwise(toks)
    return (sentences.select("side", "mult", F.explode(toks).alias("token"))
            .groupBy("side", "token").agg(F.sum("mult").alias("count")))


def build_vocab(tokens: DataFrame, min_count: int = MIN_COUNT, counted: bool = False) -> DataFrame:
    """``(side, token, idx)``: tokens seen more than ``min_count`` times on a
    side, numbered from 1 in token order; UNKNOWN takes index 0. ``tokens``
    is long ``(side, token)`` or, with ``counted``, ``(side, token, count)``."""
    counts = tokens if counted else token_counts(tokens)
    counts = counts.filter((F.col("count") > min_count) & (F.col("token") != UNKNOWN_TOKEN))
    # The frequent-token table is small and is read by several branches of
    # the numbering below; writing it once (shared working folder) runs the
    # tokenising upstream once and cuts its lineage.
    counts = materialize(counts, "token-counts")
    ranked = dense_rank_by(counts.select("side", "token"), ["side"], [F.col("token")], "idx")
    unknown = counts.select("side").distinct().select(
        "side", F.lit(UNKNOWN_TOKEN).alias("token"), F.lit(UNKNOWN_INDEX).cast("long").alias("idx"))
    return ranked.select("side", "token", "idx").unionByName(unknown)


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("side").agg((F.max("idx") + 1).alias("n"))


def index_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(row_id, side, pos, token)`` -> ``idx`` by lookup, UNKNOWN index on a miss."""
    j = tokens.join(vocab, ["side", "token"], "left")
    return j.select("row_id", "side", "pos", F.coalesce("idx", F.lit(UNKNOWN_INDEX).cast("long")).alias("idx"))


def lookup_indices(rows: DataFrame, sides: dict[str, str], vocab: DataFrame) -> DataFrame | None:
    """``rows`` with the token arrays of ``sides`` replaced by index arrays, without a row per token or a
    shuffle (a null array becomes an empty one). None if the vocabulary is larger than ``LOOKUP_BYTES`` or
    names a token twice: then a join is due."""
    vocab = materialize(vocab.select("side", "token", "idx"), "vocab")
    size, names, n = vocab.agg(F.sum(F.octet_length("token") + 64), F.count_distinct("side", "token"), F.count("token")).first()
    if (size or 0) > LOOKUP_BYTES or names != n:
        return None
    known = {(r["side"], r["token"]): r["idx"] for r in vocab.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(known)
    of = {col: side for side, col in sides.items()}
    schema = StructType()
    for f in rows.schema:
        schema.add(f.name, ArrayType(LongType()) if f.name in of else f.dataType)

    def indices(tokens: pa.ListArray, side: str) -> pa.ListArray:
        coded = tokens.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        idx = np.array([sent.value.get((side, w), UNKNOWN_INDEX) for w in words] + [UNKNOWN_INDEX], np.int64)
        at = pc.fill_null(coded.indices, len(words)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(idx[at]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([indices(b.column(c), of[c]) if c in of else b.column(c) for c in b.schema.names],
                                             names=b.schema.names)

    return rows.mapInArrow(run, schema)


def ngram_counts(indexed: DataFrame) -> DataFrame:
    """Bag-of-n-grams in long form ``(row_id, side, idx, cnt)``."""
    return indexed.groupBy("row_id", "side", "idx").agg(F.count(F.lit(1)).alias("cnt"))
