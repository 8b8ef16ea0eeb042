"""Best-fit packing by sums of squares (operator 9).

Documents become token ids plus an end id and are cut into pieces only where
they exceed a sequence. A full piece is a sequence of its own. All others are
dealt to groups of bounded size by a hash of a written row number, so neither
a hot source nor copies of one document meet in one task, and each group is
packed on its own: pieces in falling length go where the sum over residual
gaps of the squared number of open sequences with that gap becomes
smallest, among equals into the smallest gap. The sequences of a group
that are left with more than ``slack`` free tokens are opened again and their
pieces packed once more, over groups that each gather many such rests, so that
cutting the work into groups costs next to nothing.

Defined results: a null or empty text is one piece that holds the end id only;
repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import map_slices, materialize


#: Words kept in a worker's table (some 250 MB), and in a compact one.
WORD_CACHE, COMPACT_CACHE = 1_500_000, 700_000
#: Characters tokenised together.
BATCH_CHARS = 4_000_000


_CLUSTER = re.compile(r"[.,](?:[^\s\w]|_)|(?:[^\s\w]|_)[.,]").search


class WordCoder:
    """Token ids by a word-level BPE of the ``tokenizers`` library that drops
    white space. A text is the sequence of its white-space separated words, so
    each distinct word is encoded once; ids are little-endian 32-bit bytes."""

    def __init__(self, path: str, compact: bool = False):
        """``compact``: less memory, more time."""
        self.compact = compact
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def _plain(text: str) -> str:
        """The text with fewer different words and the same ids: in lower case,
        where that is what the tokenizer makes of it, and with commas and full
        stops set apart, where no other mark is next to them."""
        if text.isascii() or (is_normalized("NFC", text) and "\u0130" not in text and "\u03a3" not in text):
            text = text.lower()
            if _CLUSTER(text) is None:
                text = text.replace(",", " , ").replace(".", " . ")
        return text

    def _learn(self, words: set[str]) -> None:
        known = self.known
        plain = {w for w in words if w.isalpha()}
        ending, other = [], []
        for w in words - plain:
            if w[-1] in ".,;:!?|" and w[:-1].isalpha() and (
                    w.isascii() or normalize("NFC", w[:-1]).lower().isalpha()):
                ending.append(w)
            else:
                other.append(w)
        plain.update([w[:-1] for w in ending])
        other += {w[-1] for w in ending}.difference(known, other)
        todo = list(plain.difference(known))
        if todo:
            # One word of letters is one unit whose last token marks its end.
            ids = np.array(self.tok.encode_batch_fast([" ".join(todo)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(todo):
                raw = ids.tobytes()
                known.update(zip(todo, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:  # some letter's normal form holds a mark
                other += todo
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        known.update([(w, known[w[:-1]] + known[w[-1]]) for w in ending])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        # str.split also splits at \x1c-\x1f, which the tokenizer does not drop.
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        words = [[] if o else (self._plain(t) if self.compact else t).split() for t, o in zip(texts, odd, strict=True)]
        need = set().union(*words)
        if len(self.known) > (COMPACT_CACHE if self.compact else WORD_CACHE):
            self.known = {w: self.known[w] for w in need if w in self.known}
        self._learn(need.difference(self.known))
        get = self.known.__getitem__
        return [self._encode(t).tobytes() if o else b"".join(map(get, w))
                for t, o, w in zip(texts, odd, words, strict=True)]


@lru_cache(maxsize=2)
def word_coder(path: str, compact: bool = False) -> WordCoder:
    return WordCoder(path, compact)


def runs_of(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters; no text is cut."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
           end_id: int = 1, path: str | None = None, with_ids: bool = False, compact: bool = False) -> DataFrame:
    """One row per piece: id, uid, piece, start, length, ids_crc32 and, if
    asked for, the ids themselves (binary, little-endian 32 bit)."""
    end = np.array([end_id], "<u4").tobytes()
    wide = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as P
        coder = word_coder(path or P.path("word_bpe_49k.json"), compact)
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            keys = b["i"]
            for run in runs_of([t or "" for t in b["t"]]):
                rows = []
                for k, ids in enumerate(coder.encode(run)):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), wide)):
                        part = ids[a:a + wide]
                        rows.append((at + k, base, n, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                        base += 1
                out = pd.DataFrame(rows, columns=["k", "uid", "piece", "start", "length", "ids_crc32", "ids"])
                out.insert(0, "i", keys.take(out.pop("k")).to_numpy())
                at += len(run)
                yield out if with_ids else out.drop(columns="ids")

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = f"i {kind}, uid long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_slices(texts, cut, schema, 2048).withColumnRenamed("i", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, longest first. Moving a sequence from
    gap g to g - s changes the sum of squares by 2 - 2 N[g] + 2 N[g - s]."""
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        have = count[s:capacity]
        best, g = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            cost = np.where(have > 0, 2 - 2 * have + 2 * count[:capacity - s], never)
            if cost[0] != never:
                cost[0] = 1 - 2 * have[0]  # filled: no gap remains
            k = int(cost.argmin())
            if cost[k] <= best:
                g = s + k
        if g == capacity:
            b, made = made, made + 1
        else:
            b = open_at[g].pop()
            count[g] -= 1
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
        seq[i], off[i] = b, capacity - g
    return seq, off


def _packer(capacity: int, slack: int | None, shift: int):
    """Packs one group. ``slack``: pieces of sequences with more free tokens
    than that get a null sequence, to be packed again."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        n = pdf["length"].to_numpy()
        seq, off = sum_of_squares(n, capacity)
        ids = pd.Series((int(key[0]) << 32) + seq + shift, dtype="Int64")
        if slack is not None:
            free = capacity - np.bincount(seq, weights=n, minlength=1)
            ids = ids.mask(free[seq] > slack)
        return pd.DataFrame({"uid": pdf["uid"], "sequence_id": ids, "offset": off})
    return pack


def pack_pieces(cut: DataFrame, capacity: int = 4096, group_items: int = 20_000,
                slack: int = 16, rest_items: int = 100_000) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset.

    ``group_items`` bounds a group of the first packing, ``rest_items`` one of
    the second."""
    lean = cut.where(F.col("length") < capacity).select("uid", "length")
    groups = max(1, -(-lean.count() // group_items))

    def packed(part: DataFrame, n: int, pack) -> DataFrame:
        return (part.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(n)))
                .groupBy("g").applyInPandas(pack, "uid long, sequence_id long, offset long"))

    first = packed(lean, groups, _packer(capacity, slack if groups > 1 else None, 0))
    if groups > 1:
        first = materialize(first, "pack")
        again = first.where(F.col("sequence_id").isNull()).select("uid")
        rest = lean.join(again, "uid", "left_semi")
        n = max(1, -(-again.count() // rest_items))
        first = first.where(F.col("sequence_id").isNotNull()).unionByName(
            packed(rest, n, _packer(capacity, None, 1 << 31)))
    full = cut.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return full.unionByName(cut.where(F.col("length") < capacity).join(first, "uid"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 4096, end_id: int = 1, path: str | None = None,
                   with_ids: bool = False, group_items: int = 20_000, compact: bool = False) -> DataFrame:
    """One row per piece with its sequence and place; ``uid`` names the piece.
    ``compact`` keeps smaller word tables, for workers that do other work too."""
    cut = materialize(pieces(docs, id_col, text_col, capacity, end_id, path, with_ids, compact), "pieces")
    return pack_pieces(cut, capacity, group_items)
