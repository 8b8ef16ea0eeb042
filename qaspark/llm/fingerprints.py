"""Document fingerprints as invertible Bloom lookup sketches (operator 13).

A text is the set of its paragraphs. A paragraph ends with its line and, so that
texts of one line have several, after a blank where the hash of the last 8 bytes
says so, or after ``MAX_BYTES`` without an end; ends depend on nearby bytes only. It is a 64-bit digest, and a repeated
one takes its number among its equals. The sketch deals each digest to one of
``cells / 3`` cells in each of three parts; a cell holds the number of its
digests, their sum and the sum of their checks.

Two sketches subtract cell by cell: what both texts hold cancels out. A cell with
one digest left is known by its check; it is taken from its other cells, which
may leave one there, until nothing is left: the differing digests of
both sides. If cells are left over, both texts are sketched again in twice as
many, or as many as the texts' paragraphs differ in number. ``likeness`` is 1
minus the share of the paragraphs of both that differ.

The fingerprint is the smallest sketch as text (base64 of the number of
paragraphs, counts, sums, checks, little-endian), so equal texts have equal ones.

For neighbours in document order (``compare_with_next``) texts are dealt out by id ranges
and sorted there, and every range gets the first text of the next as its last
row: one shuffle of the texts, and no window over all of them. Defined results: a null text is empty; an empty
text has no paragraph, and two of them are alike (1.0); rows that share id and text are one
document; different texts of one id follow each other by a hash of the text; documents
without an id come last; one document alone is its own next; an empty table gives an
empty table; extra columns are ignored by the comparison and kept by the others.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns, map_slices, order_id

#: Cells of the fingerprint, a multiple of 3.
CELLS = 12
#: One blank in so many ends a paragraph, and so many bytes do where none has.
BLANKS, MAX_BYTES = 4, 128
_WINDOW = 8
_BYTE = np.random.RandomState(13).randint(0, 1 << 32, 256, dtype=np.int64).astype(np.uint32)
_BYTE[0] = 0  # the zero bytes between texts add nothing
_STEP = 0x9E3779B1
_LOW = np.uint64(0xFFFFFFFF)
_PARTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Paragraphs:
    """Digests of the paragraphs of some texts: ``of`` is the text's number."""
    of: np.ndarray
    digest: np.ndarray
    n: np.ndarray

    def some(self, texts: np.ndarray) -> "Paragraphs":
        """Those of the given texts, numbered by their place."""
        first = np.cumsum(self.n) - self.n
        n = self.n[texts]
        at = np.repeat(first[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Paragraphs(np.repeat(np.arange(len(texts)), n), self.digest[at], n)


def paragraph_ends(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) in a buffer of texts that end in a line feed and zero bytes."""
    h, n = _BYTE[data], 1
    while n < _WINDOW:
        older = h[:-n] * np.uint32(pow(_STEP, n, 1 << 32))
        h = h.copy()
        h[n:] += older
        n *= 2
    return np.flatnonzero((data == 10) | ((data == 32) & ((h >> np.uint32(16)) % BLANKS == 0))) + 1


def paragraphs_of(texts: list[str]) -> Paragraphs:
    from xxhash import xxh3_64_intdigest
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = b"\n" + b"\0" * _WINDOW
    buf = b"\0" * _WINDOW + gap.join(raws) + gap
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    begin = _WINDOW + np.cumsum(sizes + len(gap)) - (sizes + len(gap))
    stops = paragraph_ends(np.frombuffer(buf, np.uint8))
    of = np.searchsorted(begin, stops, side="left") - 1
    stops, of = stops[sizes[of] > 0], of[sizes[of] > 0]
    starts = np.maximum(np.concatenate(([0], stops[:-1])), begin[of])
    more = (stops - starts - 1) // MAX_BYTES  # ends within, counted from the start
    if more.any():
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        stops = np.sort(np.concatenate((stops, np.repeat(starts, more) + k * MAX_BYTES)))
        of = np.searchsorted(begin, stops, side="left") - 1
        starts = np.maximum(np.concatenate(([0], stops[:-1])), begin[of])
    view = memoryview(buf)
    digest = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)),
                         np.uint64, len(stops))
    order = np.lexsort((digest, of))
    same = np.concatenate(([False], (digest[order][1:] == digest[order][:-1]) & (of[order][1:] == of[order][:-1])))
    place = np.arange(len(order))
    number = np.empty(len(order), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return Paragraphs(of, _mix(digest + number * _PARTS[0]), np.bincount(of, minlength=len(texts)))


class Sketch:
    """The cells of some texts (or of differences of texts), ``cells`` each."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def add(self, of: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        third = np.uint64(self.cells // 3)
        sign = np.broadcast_to(np.asarray(sign, np.int64), of.shape)
        signed = sign.astype(np.uint64)  # wraps, as the sums do
        key, check = digest * signed, self.checks(digest) * signed
        for j, part in enumerate(_PARTS):
            at = of * self.cells + j * int(third) + ((_mix(digest ^ part) >> np.uint64(11)) % third).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    @staticmethod
    def checks(digest: np.ndarray) -> np.ndarray:
        return _mix(digest * _PARTS[1]) >> np.uint64(32)

    def texts(self, sizes: np.ndarray) -> list[str]:
        """One string for each text of ``sizes`` paragraphs."""
        shape = (self.n, self.cells)
        parts = [sizes.astype("<u4")[:, None].view(np.uint8), self.count.reshape(shape).astype("<i4").view(np.uint8),
                 self.key.reshape(shape).astype("<u8").view(np.uint8), (self.check & _LOW).reshape(shape).astype("<u4").view(np.uint8)]
        return [b64encode(row.tobytes()).decode() for row in np.concatenate(parts, axis=1)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(of, digest, sign, done): the digests recovered, 1 for those added and -1
        for those subtracted, and which differences are recovered as a whole."""
        found = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            digest = self.key[at] * sign.astype(np.uint64)
            alone = self.checks(digest) == (self.check[at] * sign.astype(np.uint64)) & _LOW
            of, digest, sign = at[alone] // self.cells, digest[alone], sign[alone]
            if not len(of):
                break
            order = np.lexsort((digest, of))
            new = np.concatenate(([True], (digest[order][1:] != digest[order][:-1]) | (of[order][1:] != of[order][:-1])))
            order = order[new]
            of, digest, sign = of[order], digest[order], sign[order]
            self.add(of, digest, -sign)
            found.append((of, digest, sign))
        left = ((self.count != 0) | (self.key != 0) | (self.check & _LOW != 0)).reshape(self.n, self.cells).any(axis=1)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), ~left
        return *[np.concatenate(x) for x in zip(*found, strict=True)], ~left


def differences(a: Paragraphs, b: Paragraphs, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of the paragraphs that only one text of each pair holds,
    1 for the first, -1 for the second; sketches grow until each pair succeeds."""
    todo, out = np.arange(len(a.n)), []
    size = np.full(len(a.n), cells)
    while len(todo):
        again = []
        for m in np.unique(size).tolist():
            pairs = todo[size == m]
            x, y = a.some(pairs), b.some(pairs)
            both = Sketch(len(pairs), m)
            both.add(x.of, x.digest, 1)
            both.add(y.of, y.digest, -1)
            of, digest, sign, done = both.peel()
            good = done[of]
            out.append((pairs[of[good]], digest[good], sign[good]))
            again.append(pairs[~done])
        # Twice as many cells, and as many as the numbers of paragraphs say at least.
        size = dict(zip(todo.tolist(), size.tolist(), strict=True))
        todo = np.concatenate(again)
        least = np.abs(a.n[todo] - b.n[todo])
        size = np.array([size[i] * 2 ** max(1, int(np.ceil(np.log2(max(1, d) / size[i])))) for i, d in zip(todo.tolist(), least.tolist(), strict=True)], np.int64)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def likeness(a: Paragraphs, b: Paragraphs, cells: int = CELLS) -> np.ndarray:
    """1 minus the share of the paragraphs of both texts of a pair that differ."""
    differ = np.bincount(differences(a, b, cells)[0], minlength=len(a.n))
    return 1 - differ / np.maximum(a.n + b.n, 1)


def fingerprints_of(p: Paragraphs, cells: int = CELLS) -> list[str]:
    s = Sketch(len(p.n), cells)
    s.add(p.of, p.digest, 1)
    return s.texts(p.n)


def _plain(texts: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in texts]


def fingerprint(docs: DataFrame, text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """``docs`` with ``fingerprint``, which replaces a column of that name."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fingerprint": fingerprints_of(paragraphs_of(_plain(texts)), cells)})

    return add_columns(docs, [text_col], run, "fingerprint string")


def compare(rows: DataFrame, left: str, right: str, cells: int = CELLS) -> DataFrame:
    """``rows`` with ``likeness`` of two text columns and the digests of the paragraphs
    that only one holds, ``only_left`` and ``only_right`` (array<long>, ascending)."""
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = paragraphs_of(_plain(x)), paragraphs_of(_plain(y))
        pair, digest, sign = differences(a, b, cells)
        digest = digest.view(np.int64)
        order = np.lexsort((digest, pair))
        pair, digest, sign = pair[order], digest[order], sign[order]
        out = {"likeness": 1 - np.bincount(pair, minlength=len(x)) / np.maximum(a.n + b.n, 1)}
        for name, s in (("only_left", 1), ("only_right", -1)):
            n = np.bincount(pair[sign == s], minlength=len(x))
            out[name] = np.split(digest[sign == s], np.cumsum(n)[:-1])
        return pd.DataFrame(out)

    return add_columns(rows, [left, right], run, "likeness double, only_left array<long>, only_right array<long>")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(doc_id, ord, th, text, part, tail): texts dealt over ranges ``part`` of their
    order and sorted there; the last row of a part has ``tail`` and is the first
    of the next part. None for an empty table."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("ord"),
                        F.xxhash64(text).alias("th"), text.alias("text"))
    cuts = keyed.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    if cuts is None:
        return None
    hot = sorted({c for c, d in zip(cuts, cuts[1:], strict=False) if c == d})
    if hot:
        # The rows of an id that fills a range: equal ones are merged before any shuffle.
        often = F.col("ord").isin(hot)
        keyed = keyed.where(~often).unionByName(
            keyed.where(often).groupBy("doc_id", "ord", "th").agg(F.first("text").alias("text")))
    cuts = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part(ords: pd.Series, hashes: pd.Series) -> pd.Series:
        lo, hi = np.searchsorted(cuts, ords, side="left"), np.searchsorted(cuts, ords, side="right")
        # An id with several cuts is dealt on by its texts.
        share = (hashes.to_numpy(np.float64) + 2.0 ** 63) / 2.0 ** 64
        return pd.Series(np.where(hi - lo > 1, np.minimum(lo + (share * (hi - lo + 1)).astype(np.int64), hi), lo).astype(np.int32))

    dealt = keyed.withColumn("part", part("ord", "th"))
    heads = dealt.groupBy("part").agg(F.min(F.struct("ord", "th")).alias("h")).orderBy("part").select("part", "h.*").collect()
    before = [h["part"] for h in heads[-1:] + heads[:-1]]  # a row for each part
    heads = spark.createDataFrame([(h["ord"], h["th"], p) for h, p in zip(heads, before, strict=True)], "ord long, th long, part int")
    tails = (keyed.join(F.broadcast(heads), ["ord", "th"]).groupBy("ord", "th", "part").agg(F.first("text").alias("text"))
             .select(F.lit(None).cast("long").alias("doc_id"), "ord", "th", "text", "part", F.lit(True).alias("tail")))
    both = dealt.withColumn("tail", F.lit(False)).unionByName(tails)
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", "ord", "th")


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next one's, and
    its likeness to the edited and to the next text."""
    ordered = in_order(docs, id_col, text_col)
    if ordered is None:
        return docs.sparkSession.createDataFrame([], _COMPARED)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for f in frames:
            rows = f if last is None else pd.concat([last, f], ignore_index=True)
            last = rows.iloc[-1:]
            texts, tail = rows["text"].to_list(), rows["tail"].to_numpy(bool)
            key = rows[["ord", "th"]].to_numpy(np.int64)
            # A row that comes again is one document.
            again = (key[1:] == key[:-1]).all(axis=1) & ~tail[1:]
            at = np.flatnonzero(~tail[:-1] & ~again)
            if not len(at):
                continue
            edited = [edit(texts[i], texts[i + 1]) for i in at.tolist()]
            all_, new = paragraphs_of(texts), paragraphs_of(edited)
            own, following = all_.some(at), all_.some(at + 1)
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].to_numpy()[at], "n_chars": [len(texts[i]) for i in at.tolist()],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": fingerprints_of(own, cells), "edited_fingerprint": fingerprints_of(new, cells),
                "near_edited": likeness(own, new, cells), "near_next": likeness(own, following, cells)})
        if last is not None and not last["tail"].iloc[0]:
            raise RuntimeError("the last row of a part is the first of the next")

    return map_slices(ordered, run, _COMPARED)
