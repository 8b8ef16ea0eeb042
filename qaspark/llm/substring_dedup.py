"""Substring dedup by content-defined chunking (operator 10).

A gear hash rolls over the UTF-8 bytes of a text: with every byte it is
shifted left and the byte's random number is added, so its 16 bits depend on
the last 16 bytes alone. A chunk ends where the hash is small, unless it was
small within the last ``MIN_CHUNK`` bytes, and never inside a character; where
no end comes for ``MAX_CHUNK`` bytes one is forced. Ends depend on nearby bytes
only, so an insertion shifts no chunk but its own.

What is deduplicated are runs of adjacent chunks: from each chunk on, as few as reach
``min_run`` bytes, by the digest (96 bits) of their bytes. The first holder by
(document, text hash, offset) keeps its run; every later one is cut out as a whole. So each byte
that goes lies in a string of at least ``min_run`` bytes that an earlier place holds as it
is, while chunks that are alike by chance, shorter than that, stay; and the first
holder of a chunk keeps it, since no run with it comes earlier. Counting is
aggregated before the shuffle, and only runs that occur twice are joined back.

Defined results: null and empty texts, and texts of fewer than ``min_run`` bytes, have no runs and stay as they are
(null becomes empty); null ids come last, ordered by a hash of the text, as do different texts of one id; rows with the
same id and text count as one document; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns, discard, map_slices, materialize, order_id

#: One place in ``MEAN_CHUNK`` ends a chunk; with ``MIN_CHUNK``, chunks are some 28
#: bytes long, so that a passage of 50 words holds several whole ones.
MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 20, 8, 1024
#: Bytes chunked together.
BATCH = 2_000_000
_GEAR = np.random.RandomState(10).randint(0, 1 << 16, 256).astype(np.uint16)
_GEAR[0] = 0  # the zero bytes between texts add nothing
_WINDOW = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte, by doubling the window."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Chunk ends (exclusive) in a buffer whose texts are 16 zero bytes apart."""
    hit = gear(data) < (1 << 16) // MEAN_CHUNK
    close = np.zeros(len(hit), bool)
    for back in range(1, MIN_CHUNK):
        close[back:] |= hit[:-back]
    hit &= ~close
    hit[:-1] &= (data[1:] & 0xC0) != 0x80  # the next byte starts a character
    return np.flatnonzero(hit) + 1


def chunks_of(texts: list[bytes], min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, digest as 16 bytes) of the run of chunks from each chunk
    on that reaches ``min_run`` bytes, where the text is long enough."""
    from xxhash import xxh3_128_digest
    gap = b"\0" * _WINDOW
    buf = gap + gap.join(texts) + gap
    data = np.frombuffer(buf, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = _WINDOW + np.concatenate(([0], np.cumsum(sizes + _WINDOW)[:-1]))
    end = begin + sizes
    cuts = chunk_ends(data)
    owner = np.searchsorted(begin, cuts, side="left") - 1
    ok = owner >= 0
    ok[ok] = cuts[ok] < end[owner[ok]]
    full = sizes > 0
    stops = np.unique(np.concatenate((cuts[ok], end[full])))
    starts = np.concatenate(([0], stops[:-1]))
    which = np.searchsorted(begin, stops, side="left") - 1
    starts = np.maximum(starts, begin[which])
    long = np.flatnonzero(stops - starts > MAX_CHUNK)
    if len(long):  # forced ends, kept off the middle of characters
        more = []
        for i in long.tolist():
            for e in range(int(starts[i]) + MAX_CHUNK, int(stops[i]), MAX_CHUNK):
                while e < stops[i] and data[e] & 0xC0 == 0x80:
                    e += 1
                more.append(e)
        stops = np.unique(np.concatenate((stops, more))).astype(np.int64)
        starts = np.concatenate(([0], stops[:-1]))
        which = np.searchsorted(begin, stops, side="left") - 1
        starts = np.maximum(starts, begin[which])
    last = np.searchsorted(stops, starts + min_run)  # the first chunk that ends there or later
    ok = last < len(stops)
    ok[ok] = which[last[ok]] == which[ok]
    which, starts, stops = which[ok], starts[ok], stops[last[ok]]
    view = memoryview(buf)
    digests = b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return which, starts - begin[which], stops - starts, np.frombuffer(digests, "<i8").reshape(-1, 2)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 96) -> DataFrame:
    """(ord, th, start, size, d1, d2) of every run of chunks of every text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ords, hashes = b["ord"].to_numpy(), b["th"].to_numpy()
            texts, n, first = [], 0, 0
            for k, t in enumerate(b["t"]):
                texts.append(t.encode("utf-8", "surrogatepass"))
                n += len(texts[-1])
                if n >= BATCH or k == len(b) - 1:
                    which, start, size, d = chunks_of(texts, min_run)
                    which = which + first
                    yield pd.DataFrame({"ord": ords[which], "th": hashes[which], "start": start.astype(np.int32),
                                        "size": size.astype(np.int32), "d1": d[:, 0], "d2": d[:, 1].astype(np.int32)})
                    texts, n, first = [], 0, k + 1

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(order_id(id_col).alias("ord"), F.xxhash64(text).alias("th"), text.alias("t"))
    return map_slices(texts, cut, "ord long, th long, start int, size int, d1 long, d2 int")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(d1, d2, f): the first place of each digest that occurs twice or more."""
    firsts = (chunks.groupBy("d1", "d2")
              .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ord", "th", "start")).alias("f"))
              .where(F.col("c") > 1).select("d1", "d2", "f"))
    # Written: a join of two plain exchanges is one whose hot keys Spark splits.
    return materialize(firsts, "first-chunks")


def repeated_chunks(chunks: DataFrame, firsts: DataFrame) -> DataFrame:
    """(ord, th, start, size) of the runs whose digest an earlier place holds."""
    return (chunks.join(firsts, ["d1", "d2"])
            .where((F.col("ord") != F.col("f.ord")) | (F.col("th") != F.col("f.th")) | (F.col("start") != F.col("f.start")))
            .select("ord", "th", "start", "size"))


def spans_of(parts: list) -> list[tuple[int, int]]:
    """Maximal spans that ascending, overlapping or adjacent (start, size) cover."""
    spans: list[list[int]] = []
    for start, size in parts:
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + size)
        else:
            spans.append([start, start + size])
    return [(a, b) for a, b in spans]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_run: int = 96) -> DataFrame:
    """All columns of ``docs`` with the text without its repeated runs, and
    ``n_bytes``, ``n_removed``, ``n_spans`` (long; they replace such columns)."""
    chunks = materialize(chunk_table(docs, id_col, text_col, min_run), "chunks")
    firsts = first_chunks(chunks)
    gone = (repeated_chunks(chunks, firsts).groupBy("ord", "th")
            .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("_sd_parts")))
    gone = materialize(gone, "repeated").withColumnsRenamed({"ord": "_sd_ord", "th": "_sd_th"})
    discard(chunks, firsts)

    def cut(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p in zip(texts, parts, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans = [] if p is None else spans_of([(x["start"], x["size"]) for x in p])
            if spans:
                edges = [0, *[e for s in spans for e in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((kept.decode("utf-8", "surrogatepass"), len(raw), len(raw) - len(kept), len(spans)))
            else:
                rows.append((t or "", len(raw), 0, 0))
        return pd.DataFrame(rows, columns=[text_col, "n_bytes", "n_removed", "n_spans"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.withColumns({"_sd_ord": order_id(id_col), "_sd_th": F.xxhash64(text)})
    both = left.join(gone, ["_sd_ord", "_sd_th"], "left").drop("_sd_ord", "_sd_th")
    return add_columns(both, [text_col, "_sd_parts"], cut,
                       f"`{text_col}` string, n_bytes long, n_removed long, n_spans long").drop("_sd_parts")
