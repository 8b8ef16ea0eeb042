"""Language identification by rank-order profiles (operator 1).

A language's profile is the list of its ``size`` most frequent n-grams (1 to 3
letters, words padded with a blank) over all its training documents. A
document's own most frequent n-grams are compared with each profile: an n-gram
at place i of the document and j of the profile costs |i - j|, one that the
profile lacks costs ``size``. The language with the smallest sum wins, the first
by name among equals; the score is 1 less that sum over the largest possible.

N-grams are counted in Spark tasks, summed by (language, n-gram) after
counting inside each task, and cut to the profiles in two steps, so a language
that holds most documents is no single task. Only the profiles (``size`` rows
per language) reach the driver and go out with the prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text when nothing can be learned; null languages teach nothing;
equal counts are ordered by code points; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns, map_slices

#: N-grams a task holds before it hands on its counts.
FLUSH = 2_000_000
#: N-grams of one language that wait to be counted together.
PENDING = 4_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Every 1-, 2- and 3-gram of a text as one integer, 21 bits a character;
    empty if the text has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    # One blank before the text and one after each word.
    c = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.int64)
    full = np.concatenate(([False], letter, [False]))
    keep = full.copy()
    keep[1:] |= full[:-1]
    keep[0] = True
    if not letter[0]:
        keep[0] = False
        keep[np.argmax(full) - 1] = True
    c, full = c[keep], full[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[full], two, three[full[1:-1]]))


def _count(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their summed counts."""
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, int)
    return g[first], np.add.reduceat(n, first) if len(g) else n


def count_ngrams(rows: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, gram, n): partial counts of each task."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waits: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def settle(name: str) -> None:
            g, n = np.unique(np.concatenate(waits.pop(name)), return_counts=True)
            size.pop(name)
            old = held.get(name)
            held[name] = (g, n) if old is None else _count([old[0], g], [old[1], n])

        def hand_on() -> Iterator[pd.DataFrame]:
            for name, (g, n) in held.items():
                yield pd.DataFrame({"lang": name, "gram": g, "n": n})
            held.clear()

        for b in batches:
            for t, name in zip(b["t"], b["l"], strict=True):
                g = ngrams(t)
                waits.setdefault(name, []).append(g)
                size[name] = size.get(name, 0) + len(g)
                if size[name] >= PENDING:
                    settle(name)
            if sum(size.values()) >= PENDING:
                for name in list(waits):
                    settle(name)
            if sum(len(g) for g, _ in held.values()) >= FLUSH:
                yield from hand_on()
        for name in list(waits):
            settle(name)
        yield from hand_on()

    return map_slices(rows.select(text.alias("t"), lang.alias("l")), count, "lang string, gram long, n long")


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   size: int = 400) -> DataFrame:
    """(lang, gram, rank): the profile of every non-null language, rank from 0."""
    rows = train.where(F.col(lang_col).isNotNull())
    sums = (count_ngrams(rows, F.col(text_col), F.col(lang_col).cast("string"))
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = [F.col("n").desc(), F.col("gram")]
    part = Window.partitionBy("lang", "part").orderBy(*top)
    some = (sums.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
            .withColumn("r", F.row_number().over(part)).where(F.col("r") <= size).drop("r", "part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*top)) - 1
    return some.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (they replace such columns)."""
    p = profiles.toPandas()  # ``size`` rows per language
    langs = sorted(p["lang"].unique())
    grams = np.unique(p["gram"].to_numpy(np.int64))
    places = np.full((len(grams) + 1, len(langs)), size, np.int32)  # last row: in no profile
    if len(p):
        places[np.searchsorted(grams, p["gram"].to_numpy()), [langs.index(x) for x in p["lang"]]] = p["rank"]

    def guess(text: str | None) -> tuple[str, float]:
        g = ngrams(text)
        if not len(g) or not langs:
            return "und", 0.0
        g, n = np.unique(g, return_counts=True)
        g = g[np.argsort(-n, kind="stable")[:size]]
        at = np.searchsorted(grams, g)
        at[at == len(grams)] = 0
        at = np.where(grams[at] == g, at, len(grams))
        ranks = places[at]
        own = np.arange(len(g), dtype=np.int32)[:, None]
        cost = np.where(ranks == size, size, np.abs(ranks - own)).sum(axis=0)
        best = int(cost.argmin())
        return langs[best], 1.0 - float(cost[best]) / (size * len(g))

    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([guess(t) for t in texts], columns=["lang_pred", "score"])

    return add_columns(docs, [text_col], label, "lang_pred string, score double")
