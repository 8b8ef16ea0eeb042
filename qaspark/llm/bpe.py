"""Byte-level BPE encoding and decoding (operator 4).

The vocabulary is an Aho-Corasick automaton over bytes mapped to Latin-1
characters. A piece of text is encoded left to right with the longest token at
each place; a token may follow another only if the pair is compatible, that
is, if merging the two tokens' bytes on their own gives back the same two
tokens. Where no compatible token leads on, the last token is shortened to
its longest prefix that is a token, or taken back, and the place is marked
dead; each place is left at most once, so the work is linear in the piece.
The result is exactly that of applying the merges by rank. Compatibility is
memoised by pair and pieces by their text, both in tables of bounded size.

The tables are built once per Python worker from the rank file, whose path is
a parameter; texts are spread by Spark and no text is cut. Defined results:
null and empty texts have no tokens; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaspark.llm.common import map_slices

#: Entries of a worker's table of pieces (two generations of this size are
#: kept) and of its table of pairs.
PIECE_CACHE = 300_000
PAIR_CACHE = 1_000_000


class BytePairCoder:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._halves[rank] = (rank, rank)
            else:
                # The one split whose halves stay as they are until they merge.
                for cut in range(1, len(token)):
                    a, b = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                    if a < rank and b < rank and a in self._halves and b in self._halves and self.compatible(a, b):
                        self._halves[rank] = (a, b)
                        self._merged[a, b] = rank
                        break
                else:
                    continue  # merges never make this token
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self._matches = automaton.iter
        self._pairs.clear()
        self._shorter = {}
        for rank in self._halves:
            t = self.bytes_of[rank]
            self._shorter[rank] = next(
                (r for r in (ranks.get(t[:n]) for n in range(len(t) - 1, 0, -1)) if r in self._halves), None)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens: no merge
        across the border may come before the merges that made them."""
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        x, y, limit = a, b, 1 << 62
        good = True
        while True:
            made = self._merged.get((x, y))
            if made is not None and made < limit:
                good = False
                break
            # Undo the later of the two border tokens.
            if x > y:
                limit, half = x, self._halves[x][1]
                if half != x:
                    x = half
                    continue
                limit, half = y + 1, self._halves[y][0]
                if half == y:
                    break
                y = half
            else:
                limit, half = y + 1, self._halves[y][0]
                if half != y:
                    y = half
                    continue
                limit, half = x, self._halves[x][1]
                if half == x:
                    break
                x = half
        if len(self._pairs) >= PAIR_CACHE:
            self._pairs.clear()
        self._pairs[a, b] = good
        return good

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest: list[int | None] = [None] * n
        for end, (rank, size) in self._matches(piece.decode("latin-1")):
            longest[end + 1 - size] = rank  # ends ascend: the longest comes last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.bytes_of[token])
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = self._shorter[token]
            while token is None:  # nothing starts here: take the last token back
                alive[at] = 0
                last = out.pop()
                at -= len(self.bytes_of[last])
                token = self._shorter[last]

    def encode(self, text: str) -> list[int]:
        cache, ids = self._cache, []
        for piece in self.find(text):
            got = cache.get(piece)
            if got is None:
                got = self._older.get(piece) or self.encode_bytes(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(cache) >= PIECE_CACHE:
                        self._older, self._cache = cache, {}
                        cache = self._cache
                    cache[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> BytePairCoder:
    return BytePairCoder(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as P
    return path or P.path("byte_bpe_multi_50k.tiktoken"), pattern or P.PATTERN


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None,
                     pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text (replaces a column of that name)."""
    def ids_of(texts: pd.Series) -> pd.Series:
        c = coder(*_vocabulary(path, pattern))
        return pd.Series([c.encode(t or "") for t in texts])

    return docs.withColumn(ids_col, F.pandas_udf(ids_of, T.ArrayType(T.IntegerType()))(F.col(text_col)))


def decode_documents(docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded",
                     path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the bytes of each id list (null: none)."""
    def bytes_of(lists: pd.Series) -> pd.Series:
        c = coder(*_vocabulary(path, pattern))
        return pd.Series([c.decode([] if x is None else [int(i) for i in x]) for x in lists])

    return docs.withColumn(bytes_col, F.pandas_udf(bytes_of, T.BinaryType())(F.col(ids_col)))


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 in one pass: ids stay in the
    Python worker, only the digests come back."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(*_vocabulary(path, pattern))
        names = {r: str(r) for r in c.bytes_of}
        for b in batches:
            rows = []
            for text in b["t"]:
                ids = c.encode(text or "")
                rows.append((len(ids),
                             hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(c.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "i", b["i"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return map_slices(texts, digest, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                      ).withColumnRenamed("i", id_col)
