"""Suffix-array dedup of repeated substrings (operator 5).

Each byte covered by a string of ``length`` bytes that also starts anywhere
else is removed. A suffix array over all bytes would sort every position of the
corpus; here what is certain is settled first, and the suffix array (module
``suffix_array``) decides the rest:

1. Every string of ``length`` bytes contains an anchor: the place with the
   smallest hash of ``gram`` bytes among its first ``window`` places. It depends
   on the string alone, so equal strings have equal anchors at equal offsets.
   Adjacent strings with the same anchor form a run; all share a core of
   ``length - window + 1`` bytes from the anchor on.
2. Runs whose core occurs once hold no repeat. Runs equal as a whole are repeats
   throughout. Runs that share a core and differ elsewhere remain, one of each
   kind, and are split by offset from the anchor into shorter and shorter runs
   (``steps``), whose cores grow; each step settles what it can.
3. The remaining runs are written as strings of few symbols: the bytes left of
   the core, the core as one symbol, the bytes right of it. A string of
   ``length`` bytes is then one of ``steps[-1]`` symbols, and the difference-cover
   suffix array of these strings gives the repeats: a neighbour with the same
   prefix of that many symbols.

Cores and runs are compared by 64-bit and 96-bit hashes, counted after
aggregation in each task. Defined results: null and short texts lose nothing;
every row is a text of its own, so repeated rows repeat each other; a null id
is a valid id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns, discard, map_slices, materialize, order_id
from qaspark.llm.suffix_array import suffix_ranks

_BYTE = np.random.RandomState(5).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place on."""
    h, n = _BYTE[data], 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(_STEP, n, 1 << 64)) + h[n:]
        n *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of ``w``."""
    x = np.concatenate((v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:len(v) - w + 1], left[w - 1:len(v)])


def runs_of(raw: bytes, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor) of each run of starts of strings of ``length``."""
    starts = len(raw) - length + 1
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)[:starts + window - 1]
    low = np.uint64(0xFFFFFFFF)
    # The leftmost of equal hashes: place in the low bits.
    anchor = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), window) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return first, np.concatenate((first[1:], [starts])) - 1, anchor[first]


_RUN = "ord long, th long, p0 int, m int, s int, c long, f1 long, f2 int"


def _row(raw: bytes, base: int, a: int, e: int, s: int, core: int, length: int, tag: int) -> tuple:
    """Keys of the run of starts a..e (absolute) with anchor s; ``raw`` begins at ``base``."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest
    d = xxh3_128_digest(raw[a - base:e + length - base], seed=s - a + 1_000_000)
    c = xxh3_64_intdigest(raw[s - base:s + core - base], seed=tag)
    return a, e - a + 1, s, c - (1 << 63), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little", signed=True)


def all_runs(texts: DataFrame, length: int, window: int, gram: int) -> DataFrame:
    """Runs of every text (ord, th, t) with their keys."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, h, t in zip(b["ord"], b["th"], b["t"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    for a, e, s in zip(*(x.tolist() for x in runs_of(raw, length, window, gram)), strict=True):
                        rows.append((o, h, *_row(raw, 0, a, e, s, length - window + 1, length, 0)))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "c", "f1", "f2"])
                    rows = []
            yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "c", "f1", "f2"])

    return map_slices(texts, cut, _RUN)


def settle(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeats, rest): runs equal to another run, as (ord, th, p0, m); one of
    each kind of run that shares its core with another kind. ``runs`` is a written
    table, deleted once read."""
    # Written: a join of two plain exchanges is one whose hot keys Spark splits.
    shared = materialize(runs.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("c"), "shared")
    some = materialize(runs.join(shared, "c"), "runs")
    kinds = materialize(some.groupBy("c", "f1", "f2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "th", "p0", "m", "s")).alias("r")), "kinds")
    discard(runs, shared)
    repeats = some.join(kinds.where(F.col("n") > 1).select("c", "f1", "f2"), ["c", "f1", "f2"])
    torn = materialize(kinds.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("c"), "torn")
    return repeats.select("ord", "th", "p0", "m"), kinds.join(torn, "c").select("c", "r.*")


_PART = "ord long, th long, p0 int, m int, s int, text binary"


def parts_of_texts(texts: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """The bytes of the remaining runs, read from their texts."""
    wanted = rest.groupBy("ord", "th").agg(F.collect_list(F.struct("p0", "m", "s")).alias("runs"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, h, t, runs in zip(b["ord"], b["th"], b["t"], b["runs"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                rows += [(o, h, r["p0"], r["m"], r["s"], raw[r["p0"]:r["p0"] + r["m"] + length - 1]) for r in runs]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "text"])
                    rows = []
            yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "text"])

    # Rows that share id and text would bring the same run twice.
    return map_slices(texts.join(wanted, ["ord", "th"]), read, _PART).dropDuplicates(["ord", "th", "p0"])


def _split(p0: int, m: int, s: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, core start, block) of the starts p0 .. p0+m-1 by offset from s."""
    for block in range((s - (p0 + m - 1)) // step, (s - p0) // step + 1):
        q = s - block * step
        yield max(p0, q - step + 1), min(p0 + m - 1, q), q, block


def split_parts(parts: DataFrame, step: int, length: int) -> DataFrame:
    """Runs of at most ``step`` starts, with their keys."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, h, p0, m, s, raw in zip(*(b[c] for c in ("ord", "th", "p0", "m", "s", "text")), strict=True):
                rows += [(o, h, *_row(raw, p0, a, e, q, length - step + 1, length, block))
                         for a, e, q, block in _split(p0, m, s, step)]
            yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "c", "f1", "f2"])

    return parts.mapInPandas(cut, _RUN)


def parts_of_parts(parts: DataFrame, rest: DataFrame, step: int, length: int) -> DataFrame:
    """The bytes of the runs of ``rest``, read from the longer runs that hold them."""
    wanted = rest.select("ord", "th", "p0")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, h, p0, m, s, raw in zip(*(b[c] for c in ("ord", "th", "p0", "m", "s", "text")), strict=True):
                rows += [(o, h, a, e - a + 1, q, raw[a - p0:e + length - p0]) for a, e, q, _ in _split(p0, m, s, step)]
            yield pd.DataFrame(rows, columns=["ord", "th", "p0", "m", "s", "text"])

    return parts.mapInPandas(cut, _PART).join(wanted, ["ord", "th", "p0"], "left_semi")


def symbol_strings(parts: DataFrame, rest: DataFrame, step: int, length: int) -> DataFrame:
    """(sid, ord, th, p0, t): the remaining runs as strings of symbols."""
    core = length - step + 1

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p0, s, c, raw in zip(b["p0"], b["s"], b["c"], b["text"], strict=True):
                at = s - p0
                mid = (1 << 60) + ((c + (1 << 63)) >> 4)  # one symbol, above all bytes
                rows.append([x + 1 for x in raw[:at]] + [mid] + [x + 1 for x in raw[at + core:]])
            yield pd.DataFrame({"ord": b["ord"], "th": b["th"], "p0": b["p0"], "t": rows})

    both = parts.join(rest.select("ord", "th", "p0", "c"), ["ord", "th", "p0"])
    return materialize(both.select("ord", "th", "p0", "s", "c", "text").mapInPandas(
        write, "ord long, th long, p0 int, t array<long>").withColumn("sid", F.monotonically_increasing_id()), "symbols")


def repeated_starts(texts: DataFrame, length: int, window: int, gram: int, steps: tuple[int, ...]) -> DataFrame:
    """(ord, th, p0, m): the m starts from p0 on begin a string of ``length``
    bytes that also starts elsewhere."""
    found, rest = settle(materialize(all_runs(texts, length, window, gram), "all-runs"))
    parts = materialize(parts_of_texts(texts, rest, length), "parts")
    for i, step in enumerate(steps):
        more, rest = settle(materialize(split_parts(parts, step, length), "split"))
        found = found.unionByName(more)
        rest = materialize(rest, "rest")
        whole, parts = parts, parts_of_parts(parts, rest, step, length)
        if i < len(steps) - 1:
            parts = materialize(parts, "parts")
            discard(whole)
    strings = symbol_strings(parts, rest, steps[-1], length)
    twins = suffix_ranks(strings.select("sid", "t"), steps[-1]).where("twin").select("sid", "pos")
    last = twins.join(strings.select("sid", "ord", "th", "p0"), "sid").select(
        "ord", "th", (F.col("p0") + F.col("pos")).cast("int").alias("p0"), F.lit(1).alias("m"))
    return found.unionByName(last)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   window: int = 256, gram: int = 32, steps: tuple[int, ...] = (32, 4)) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``n_removed``, ``n_spans`` (long),
    ``spans`` (start and end in bytes) and ``kept`` (the remaining bytes); they
    replace columns of those names. ``gram`` is a power of two and
    ``window + gram - 1 <= length``; ``window > steps[0] > ... > 1``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(order_id(id_col).alias("ord"), F.xxhash64(text).alias("th"), text.alias("t"))
    starts = repeated_starts(texts, length, window, gram, steps)
    per_text = (starts.groupBy("ord", "th").agg(F.sort_array(F.collect_set(F.struct("p0", "m"))).alias("_sa_runs"))
                .withColumnsRenamed({"ord": "_sa_ord", "th": "_sa_th"}))

    def cut(column: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(column, runs, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for r in () if found is None else found:
                a, e = r["p0"], r["p0"] + r["m"] - 1 + length
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([a, e])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw), len(raw) - len(kept), len(spans), [{"start": a, "end": e} for a, e in spans], kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])

    left = docs.withColumns({"_sa_ord": order_id(id_col), "_sa_th": F.xxhash64(text)})
    both = left.join(per_text, ["_sa_ord", "_sa_th"], "left").drop("_sa_ord", "_sa_th")
    return add_columns(both, [text_col, "_sa_runs"], cut, "n_bytes long, n_removed long, n_spans long, "
                       "spans array<struct<start: long, end: long>>, kept binary").drop("_sa_runs")
