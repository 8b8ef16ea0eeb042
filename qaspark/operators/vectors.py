"""Word vectors: corpus frequencies, the UNKNOWN vector, sentence mean vectors,
cosine distance."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from qaspark.functions import text as T
from qaspark.functions import vector as V
from qaspark.session import materialize, swept

# FIXED VALUE - a corpus token is rare (feeds the UNKNOWN vector) at or below this count.
RARE_MAX_COUNT = 4
LINE_END = r"\r\n|\r|\n"
#: What the symbol cleaner trims by its place in a line: quotes at the ends, and blanks before a
#: last character that a regular expression takes for a line end. Any other line is cleaned word by word alike.
EDGED = "['\u0085\u2028\u2029]"
# Largest vector width accepted where a vector is held as a model parameter.
MAX_WIDTH = 4096
#: Bytes of word vectors sent to every task (more are met in parts), of the vectors
#: of a part, and sentences looked up together.
LOOKUP_BYTES, PART_BYTES, LOOKUP_ROWS = 16 << 20, 128 << 20, 1024
#: Word vectors gathered at once while sentences are added up: they stay in a core's cache.
SUM_ROWS = 8192


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> ``(doc_id, line_no, tokens)``: one sentence per line,
    symbol-cleaned and whitespace-split."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), LINE_END)).alias("line_no", "line"))
    return lines.select(id_col, "line_no", T.split_ws(T.no_symbol(F.col("line"))).alias("tokens"))


def corpus_counts(lines: DataFrame) -> DataFrame:
    return (lines.select(F.explode("tokens").alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, whole, count)``: the blank-separated words of the documents' lines as they stand. ``whole`` marks
    words of lines whose tokens follow from the whole line only (:data:`EDGED`)."""
    lines = docs.select(F.explode(F.split(F.col(text_col), LINE_END)).alias("line"))
    # The mark is made before the words are set apart: beside the generator it would scan the line once a word.
    words = (lines.select("line", F.col("line").rlike(EDGED).alias("whole"))
             .select("whole", F.explode(F.split("line", r"\s+")).alias("word")))
    return words.where(F.col("word") != "").groupBy("word", "whole").agg(F.count(F.lit(1)).alias("count"))


def corpus_counts_of_words(words: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`corpus_counts` from :func:`corpus_words`: every different word is cleaned once, and only lines
    that need it are cleaned as a whole."""
    each = words.where(~F.col("whole")).select(F.explode(T.split_ws(T.no_symbol("word"))).alias("token"), "count")
    lines = (docs.where(F.col(text_col).rlike(EDGED)).select(F.explode(F.split(F.col(text_col), LINE_END)).alias("line"))
             .where(F.col("line").rlike(EDGED)))
    tokens = lines.select(F.explode(F.split(T.no_symbol("line"), r"\s+")).alias("token")).where(F.col("token") != "")
    rest = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return each.unionByName(rest).groupBy("token").agg(F.sum("count").alias("count"))


def width(vectors: DataFrame, col: str = "vec") -> int:
    """Length of the vectors, read from one row. A model parameter: matrices of
    width x width are held by the driver and every task, so it is limited."""
    row = vectors.select(F.size(col).alias("d")).first()
    if row is None:
        raise ValueError("no vector to take a width from")
    if row["d"] > MAX_WIDTH:
        raise ValueError(f"vector width {row['d']} exceeds {MAX_WIDTH}")
    return row["d"]


def unknown_vector(counts: DataFrame, vectors: DataFrame, rare_max: int = RARE_MAX_COUNT) -> DataFrame:
    """Mean vector of the rare corpus tokens that own a vector (one row,
    ``vec`` NULL if there are none) plus their count."""
    rare = counts.filter(F.col("count") <= rare_max).select("token")
    owned = rare.join(vectors.select("token", *packed("vec")).hint("merge"), "token").select(F.coalesce(F.col("_f4").cast("array<double>"), "_f8").alias("vec"))
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vec"))))
    return owned.agg(F.when(F.count(F.lit(1)) > 0, mean).alias("vec"), F.count(F.lit(1)).alias("n_rare"))


def unknown_values(counts: DataFrame, vectors: DataFrame, d: int, rare_max: int = RARE_MAX_COUNT) -> list[float]:
    """The UNKNOWN vector as a small list on the driver (``d`` numbers)."""
    with swept(vectors.sparkSession):
        row = unknown_vector(counts, vectors, rare_max).first()
    return list(row["vec"]) if row["vec"] is not None else [0.0] * d


def low_frequency_tokens(counts: DataFrame, vectors: DataFrame, rare_max: int = RARE_MAX_COUNT) -> DataFrame:
    return counts.filter(F.col("count") <= rare_max).select("token").join(vectors.select("token"), "token")


def with_unknown(vectors: DataFrame, unknown: Sequence[float], token: str = "UNKNOWN") -> DataFrame:
    """Add the UNKNOWN row to a ``(token, vec)`` table."""
    spark = vectors.sparkSession
    u = spark.range(1).select(F.lit(token).alias("token"), V.literal(unknown).alias("vec"))
    return vectors.filter(F.col("token") != token).unionByName(u)


def long_sides(df: DataFrame, ids: Sequence[str], sides: dict) -> DataFrame:
    """One row per side, ``(ids, side, tokens)``, from token-array columns
    ``{side: column}`` in one pass over ``df``."""
    each = [F.struct(F.lit(side).alias("side"), F.col(c).alias("tokens")) for side, c in sides.items()]
    return df.select(*ids, F.explode(F.array(*each)).alias("_s")).select(*ids, "_s.side", "_s.tokens")


class Lookup:
    """Word vectors by token. The last row of the matrix is the UNKNOWN vector."""

    def __init__(self, tokens: list[str], matrix: np.ndarray, unknown: Sequence[float]):
        self.place = {t: i for i, t in enumerate(tokens)}
        self.matrix = np.vstack([matrix.reshape(len(tokens), -1) if len(tokens) else np.zeros((0, len(unknown))), np.asarray(unknown, np.float64)])
        self.live = (self.matrix != 0).any(axis=1)
        self.many: dict[str, list[int]] | None = None
        if len(self.place) < len(tokens):  # a token with several vectors
            self.many = {}
            for i, t in enumerate(tokens):
                self.many.setdefault(t, []).append(i)
            self.many = {t: sorted(rows, key=lambda i: self.matrix[i].tolist()) for t, rows in self.many.items()}

    def _words(self, words: pa.Array) -> tuple[list[str], np.ndarray]:
        """The distinct words and the place of each word in them; a null is behind the last."""
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        return known, pc.fill_null(coded.indices, len(known)).to_numpy(zero_copy_only=False).astype(np.int64)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Matrix row of each word."""
        last = len(self.matrix) - 1
        known, at = self._words(words)
        return np.array([*(self.place.get(w, last) for w in known), last], np.int64)[at]

    def all_rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Matrix rows of each word, every one of a token with several, and how many of them each word has."""
        if self.many is None:
            rows = self.rows(words)
            return rows, np.ones(len(rows), np.int64)
        last = [len(self.matrix) - 1]
        known, at = self._words(words)
        found = [np.array(x, np.int64) for x in [*(self.many.get(w, last) for w in known), last]]
        each = [found[i] for i in at]
        return np.concatenate(each) if each else np.empty(0, np.int64), np.array([len(x) for x in each], np.int64)

    def sums(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the vectors and number of the non-zero ones of each token list."""
        rows = self.rows(tokens.flatten())
        n = list_lengths(tokens)
        of = np.repeat(np.arange(len(n)), n)
        of, rows = of[self.live[rows]], rows[self.live[rows]]
        total = np.zeros((len(n), self.matrix.shape[1]))
        live = np.bincount(of, minlength=len(n))
        if len(of):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            ends, at = np.append(first[1:], len(of)), 0
            while at < len(first):  # whole sentences of some SUM_ROWS vectors at a time
                to = max(at + 1, int(np.searchsorted(ends, first[at] + SUM_ROWS, side="right")))
                here = self.matrix[rows[first[at]:ends[to - 1]]]
                total[of[first[at:to]]] = np.add.reduceat(here, first[at:to] - first[at])
                at = to
        return total, live


def list_lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def vector_lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an array of vectors."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), pa.float64()))


def packed(vec: str | Column) -> list[Column]:
    """A vector for the way, as ``_f4`` or ``_f8``: in 32-bit numbers if they hold it exactly, as those of a table in 32 bits do."""
    v = F.col(vec) if isinstance(vec, str) else vec
    small = F.coalesce(F.forall(v, lambda x: x.cast("float").cast("double") == x), F.lit(False))
    return [F.when(small, v.cast("array<float>")).alias("_f4"), F.when(~small, v).alias("_f8")]


def unpacked(f4: pa.ListArray, f8: pa.ListArray, d: int) -> np.ndarray:
    """The numbers of :func:`packed` vectors of ``d`` numbers each, one after the other."""
    if f4.null_count == len(f4):
        return f8.flatten().to_numpy(zero_copy_only=False).copy()
    if not f4.null_count:
        return f4.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out, small = np.empty((len(f4), d)), f4.is_valid().to_numpy(zero_copy_only=False)
    out[small] = f4.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    out[~small] = f8.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return out.ravel()


def meet(rows: DataFrame, words: Column, vectors: DataFrame, unknown: Sequence[float], run: Callable, out: StructType) -> DataFrame:
    """``run(lookup, batch)`` over ``rows`` (a written table: it is read three times), each task with the vectors of the words that its rows name
    (``words``, an array of strings over the columns of ``rows``). Rows are dealt to parts of some
    ``PART_BYTES`` of vectors; a part is sent each of its words' vectors once, by a join on the distinct
    (part, word) pairs, in 32-bit numbers where they hold it exactly. Neither a vector per word nor the vector table passes through one task or the driver."""
    spark = rows.sparkSession
    per_part = max(1024, PART_BYTES // (8 * max(1, len(unknown))))
    with swept(spark):
        n = rows.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-n // per_part), min(spark.sparkContext.defaultParallelism, n // LOOKUP_ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    named = dealt.select("_part", F.explode(F.array_distinct(words)).alias("_token")).where(F.col("_token").isNotNull()).distinct()
    # Joined by sorting: a table of vectors may be far smaller as a file than in the driver's memory.
    known = vectors.select(F.col("token").alias("_token"), *packed("vec")).hint("merge")
    sent = named.join(known, "_token").select("_part", F.lit(0).alias("_kind"), "_token", "_f4", "_f8",
                                              *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    asked = dealt.select("_part", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_token"),
                         F.lit(None).cast("array<float>").alias("_f4"), F.lit(None).cast("array<double>").alias("_f8"), *rows.columns)
    names, unknown = rows.columns, list(unknown)
    arrow = to_arrow_schema(out)

    def task(batches):
        tokens, vecs, lookup = [], [], None
        for b in batches:  # sorted: the vectors, then the rows
            k = int((b.column("_kind").to_numpy() == 0).sum())
            if k:
                head = b.slice(0, k)
                tokens += head.column("_token").to_pylist()
                vecs.append(unpacked(head.column("_f4"), head.column("_f8"), len(unknown)))
            if k < b.num_rows:
                if lookup is None:
                    lookup = Lookup(tokens, np.concatenate(vecs) if vecs else np.empty(0), unknown)
                rest = b.slice(k).select(names)
                for at in range(0, rest.num_rows, LOOKUP_ROWS):
                    got = run(lookup, rest.slice(at, LOOKUP_ROWS))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(got, arrow)], schema=arrow)

    return (sent.unionByName(asked).repartitionById(parts, F.col("_part")).sortWithinPartitions("_kind")
            .drop("_part").mapInArrow(task, out))


def split_shared(rows: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``ids`` of their own, and those (if any) that share them or lack one."""
    ids = list(ids)
    lacks = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ids])
    shared = materialize(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | lacks).select(*ids), "shared-ids")
    if shared.isEmpty():
        return rows, None
    whole = shared.where(~lacks)
    return (rows.where(~lacks).join(whole, ids, "left_anti"),
            rows.where(lacks).unionByName(rows.join(whole, ids, "left_semi")))


def _sent_sums(sentences: DataFrame, ids: list[str], lookup: Lookup, out: StructType) -> DataFrame:
    """``(ids, _sum, _live)`` of every sentence, the word vectors sent to every task."""
    arrow = to_arrow_schema(out)
    sent = sentences.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, LOOKUP_ROWS):
                got = _sums(sent.value, b.slice(at, LOOKUP_ROWS), ids)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(got, arrow)], schema=arrow)

    return sentences.mapInArrow(run, out)


def _sums(lookup: Lookup, batch: pa.RecordBatch, ids: list[str]) -> list:
    total, live = lookup.sums(batch.column("_tokens"))
    return [*[batch.column(c) for c in ids], vector_lists(total), pa.array(live, pa.int64())]


def sentence_vectors(sentences: DataFrame, ids: Sequence[str], tokens_col: str, vectors: DataFrame,
                     unknown: Sequence[float], block_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Mean word vector per sentence: unseen words take the UNKNOWN vector,
    all-zero vectors are skipped and not counted, no words -> zero vector.

    The vector table is measured first: up to ``block_bytes`` it is sent to the tasks, which look up and
    add a sentence's words in one go, without a shuffle; a larger one meets the sentences in
    parts (:func:`meet`)."""
    ids = list(ids)
    d = len(unknown)
    held = sentences.select(*ids, F.col(tokens_col).alias("_tokens"))
    out = StructType([held.schema[c] for c in ids]).add("_sum", ArrayType(DoubleType())).add("_live", LongType())
    size = vectors.agg(F.sum(F.octet_length("token") + 8 * d + 64)).first()[0] or 0
    if size > block_bytes:
        sums = meet(materialize(held, "sentences"), F.col("_tokens"), vectors, unknown, lambda lookup, batch: _sums(lookup, batch, ids), out)
    else:
        got = vectors.select("token", "vec").toArrow()  # at most about block_bytes
        lookup = Lookup(got["token"].to_pylist(), got["vec"].combine_chunks().flatten().to_numpy(), unknown)
        sums = _sent_sums(held, ids, lookup, out)
    mean = F.transform("_sum", lambda x: x / F.greatest(F.col("_live"), F.lit(1)))
    return sums.select(*ids, mean.alias("vec"))


def pivot_sides(v: DataFrame, ids: Sequence[str], sides: dict, side_col: str = "side",
                vec_col: str = "vec") -> DataFrame:
    """Long ``(ids, side, vec)`` -> one row per ``ids`` with a column per side,
    in one aggregation (the upstream plan runs once, not once per side)."""
    aggs = [F.max_by(vec_col, F.col(side_col) == F.lit(val)).alias(out) for out, val in sides.items()]
    present = [F.max((F.col(side_col) == F.lit(val)).cast("int")).alias(f"_has_{out}") for out, val in sides.items()]
    g = v.groupBy(*ids).agg(*aggs, *present)
    for out in sides:
        g = g.filter(F.col(f"_has_{out}") == 1)
    return g.drop(*[f"_has_{out}" for out in sides])
