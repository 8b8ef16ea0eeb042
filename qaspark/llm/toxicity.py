"""Toxicity by nearest labelled examples (operator 8).

The model is learned from at most ``max_rows`` labelled texts of each class,
picked by a hash of their id; the copies of a text are one, with the smallest id,
and count for the class's share of the labelled rows only. Terms are lower-case words. The
first ``max_examples`` texts of each class (of at most ``max_bytes`` in all) are the examples, and all
of their terms span the space. A term weighs (1 + ln tf) idf; one that marks the
toxic class weighs more, by its odds and chi-square in the rows learned from, and
none weighs less: with plain idf the words of a long text outweigh the few that
matter (see the README). Document frequencies come from all documents.

The index is a block-max inverted index. Examples are cut into blocks of
``BLOCK``; a term's postings are grouped by block, with the largest weight of each
group. Terms in many examples have a dense row instead and are summed for all examples
at once. The k-th largest of these partial sums is a lower bound of the k-th cosine, and the
best partial sum of a block plus the sum of the largest weights of the other terms an
upper bound of its cosines: blocks below are not read. The best blocks are read
first, which raises the lower bound for the others. These sums are in
single precision; all examples within the proven error of the k-th are then
compared in double precision, so the nearest examples are exact. They vote
with their cosine, each class weighted back to its share of the labelled rows;
a monotone map fitted on the examples themselves, each left out of its own
vote unless it has copies, turns votes into probabilities. The neighbours are the evidence.

What is learned is bounded by ``max_rows`` and ``max_bytes``, so
it is sent to every task; frequencies are counted in Spark. Defined results: a text without
any term of the space (null and empty ones too) gets the share of toxic
examples among examples like it; without labels every score is 0; a document
labelled repeatedly is toxic if one label says so; null labels and labels of
unknown documents are ignored; ties go to the smaller example id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import add_columns, map_slices, materialize

_WORDS = re.compile(r"[^\W\d_]+").findall
#: Weight of a term per unit of log odds of the toxic class, over 1 for any term.
MARK = 1.0
#: A term in one of so many examples has a dense row in the index, so many rows at most.
DENSE, MAX_DENSE = 32, 2048
#: Examples of a block, blocks read first, and texts compared with the examples at a time.
BLOCK, FIRST, BATCH = 16, 16, 128
#: Terms a task counts before it hands them on.
FLUSH = 400_000


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def class_counts(rows: DataFrame, text_col: str, label_col: str, example_col: str) -> DataFrame:
    """(term, toxic, clean): labelled rows of each class with the term, for the
    terms of the examples."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[int]] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(t, *n) for t, n in sums.items()], columns=["term", "toxic", "clean", "examples"])
            sums.clear()
            return out

        for b in batches:
            for text, y, e in zip(b["t"], b["y"], b["e"], strict=True):
                at, e = 0 if y else 1, int(e)
                for term in set(words_of(text)):
                    n = sums.setdefault(term, [0, 0, 0])
                    n[at] += 1
                    n[2] += e
                if len(sums) >= FLUSH:
                    yield hand_on()
        yield hand_on()

    texts = rows.select(F.col(text_col).alias("t"), F.col(label_col).alias("y"), F.col(example_col).alias("e"))
    return (map_slices(texts, count, "term string, toxic long, clean long, examples long").groupBy("term")
            .agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "examples")])
            .where(F.col("examples") > 0).drop("examples"))


def mark_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, min_chi2: float) -> np.ndarray:
    """1 for a term that does not mark the toxic class, more by the log odds of one
    that does; ``min_chi2`` is the chi-square at which half of that counts."""
    a, b = toxic.astype(np.float64), clean.astype(np.float64)
    c, d, n = n_toxic - a, n_clean - b, float(n_toxic + n_clean)
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n_toxic * n_clean, 1.0)
    odds = (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))
    return 1 + MARK * np.maximum(np.log(odds), 0.0) * chi2 / (chi2 + min_chi2)


class TermSpace:
    """Term counts of a text over the terms of the examples."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}

    def places(self, text: str | None) -> np.ndarray:
        """Places of the text's terms, each once."""
        words = set(words_of(text))
        t = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        return t[t >= 0]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of the text's terms and how often they occur."""
        words = Counter(words_of(text))
        t = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        order = np.argsort(t, kind="stable")[np.count_nonzero(t < 0):]
        return t[order], np.fromiter(words.values(), np.float64, len(words))[order]


def document_frequencies(docs: DataFrame, text_col: str, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, df, n = TermSpace(terms), np.zeros(len(terms) + 1, np.int64), 0
        for b in batches:
            for text in b["t"]:
                df[space.places(text)] += 1
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"i": at, "n": df[at]})

    rows = (map_slices(docs.select(F.col(text_col).alias("t")), count, "i int, n long")
            .groupBy("i").agg(F.sum("n").alias("n")).toArrow())  # a row a term
    df = np.zeros(len(terms) + 1, np.int64)
    df[rows["i"].to_numpy()] = rows["n"].to_numpy()
    return int(df[-1]), df[:-1]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each span, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class ExampleIndex:
    """Exact nearest examples by the cosine over all of their terms. ``read`` counts
    the pairs of a text and a block, and those of them that were read."""

    def __init__(self, terms: list[str], scale: np.ndarray, ids: np.ndarray, labels: np.ndarray,
                 counts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        # Examples of one class and of like size share blocks.
        order = sorted(range(len(ids)), key=lambda i: (labels[i], len(counts[i][0]), ids[i]))
        self.order = np.array(order)
        ids, labels, weights, counts = ids[order], labels[order], weights[order], [counts[i] for i in order]
        self.terms, self.scale, self.ids, self.labels, self.weights = terms, scale, ids, labels, weights
        self.space = TermSpace(terms)
        self.vectors = [self.vector(c) for c in counts]
        self.sizes = np.array([len(t) for t, _ in self.vectors], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.t = np.concatenate([t for t, _ in self.vectors]).astype(np.int32)
        self.w = np.concatenate([w for _, w in self.vectors])
        self.vectors = [(self.t[a:a + m], self.w[a:a + m]) for a, m in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]
        self.blocks = -(-len(ids) // BLOCK)
        held = np.repeat(np.arange(len(ids), dtype=np.int32), self.sizes)
        df = np.bincount(self.t, minlength=len(terms))
        often = df * DENSE >= len(ids)
        often[np.argsort(-df, kind="stable")[MAX_DENSE:]] = False
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        m = often[self.t]
        self.dense[self.row[self.t[m]], held[m]] = self.w[m]
        # Postings by term and block; group g has postings first[g] to first[g + 1].
        rare = np.flatnonzero(~m)
        rare = rare[np.lexsort((held[rare], self.t[rare]))]
        self.held, self.held_w = held[rare], self.w[rare].astype(np.float32)
        t, block = self.t[rare], self.held // BLOCK
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (block[1:] != block[:-1]))))
        self.first = np.concatenate((new, [len(t)]))
        self.block = block[new]
        self.most = np.maximum.reduceat(self.held_w, new) if len(new) else np.empty(0, np.float32)
        self.groups = np.searchsorted(t[new], np.arange(len(terms) + 1))
        self.votes = self.values = np.empty(0)
        self.read = [0, 0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}  # views of t and w

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length weights (1 + ln tf) scale."""
        t, n = counts
        w = (1 + np.log(n)) * self.scale[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(place, cosine) of the k nearest examples with a cosine above 0."""
        return self.nearest_all([(t, w)], k)[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int,
                    leave_out: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
        """The nearest of each vector; ``leave_out[i]``: the i-th example is not a neighbour of the i-th vector."""
        out, full = [], np.zeros(len(self.terms))
        for lo in range(0, len(vectors), BATCH):
            part = vectors[lo:lo + BATCH]
            but = np.full(len(part), -1)
            if leave_out is not None:
                m = leave_out[lo:lo + BATCH]
                but[m] = lo + np.flatnonzero(m)
            for (t, w), near, b in zip(part, self._candidates(part, k, but), but.tolist(), strict=True):
                out.append(self._exactly(t, w, near[near != b], k, full))
        return out

    def _candidates(self, part: list, k: int, but: np.ndarray) -> list[np.ndarray]:
        """Examples that can be among the k nearest of each vector."""
        n, width = len(part), self.blocks * BLOCK
        of = np.repeat(np.arange(n), [len(t) for t, _ in part])
        t, w = np.concatenate([t for t, _ in part]), np.concatenate([w for _, w in part])
        row = self.row[t]
        often = np.zeros((n, len(self.dense)), np.float32)
        often[of[row >= 0], row[row >= 0]] = w[row >= 0]
        rough = (often @ self.dense).astype(np.float64)
        left = np.flatnonzero(but >= 0)
        rough[left, but[left]] = 0
        # A single-precision sum of m products of at most 1 in all is off by less than (m + 4) 2^-24.
        error = (np.count_nonzero(often, axis=1) + 8) * 2.0 ** -23
        sizes = self.groups[t + 1] - self.groups[t]
        group = _spans(self.groups[t], sizes)
        of, w = np.repeat(of, sizes), np.repeat(w, sizes)
        cell = of * self.blocks + self.block[group]
        bound = np.bincount(cell, weights=w * self.most[group], minlength=n * self.blocks).reshape(n, self.blocks)
        bound = bound + rough.reshape(n, self.blocks, BLOCK).max(axis=2) + 4 * error[:, None]
        first = np.zeros((n, self.blocks), bool)
        first[np.arange(n)[:, None], np.argsort(-bound, axis=1)[:, :FIRST]] = True
        seen = np.zeros((n, self.blocks), bool)
        for best in (True, False):
            kth = self._kth(rough, k) - 2 * error
            # A block without a shared term in any example has the bound 4 error.
            wanted = (bound >= kth[:, None]) & (bound > 4 * error[:, None]) & ~seen & (first if best else True)
            at = wanted.ravel()[cell]
            g = group[at]
            sizes = self.first[g + 1] - self.first[g]
            post = _spans(self.first[g], sizes)
            add = np.repeat(w[at], sizes) * self.held_w[post]
            rough += np.bincount(np.repeat(of[at], sizes) * width + self.held[post], weights=add, minlength=n * width).reshape(n, width)
            rough[left, but[left]] = 0
            seen |= wanted
        self.read = [self.read[0] + seen.size, self.read[1] + int(seen.sum())]
        kth = self._kth(rough, k) - 2 * error
        fits = (rough >= kth[:, None]) & (rough > 0) & np.repeat(seen, BLOCK, axis=1)
        return [np.flatnonzero(x) for x in fits]

    @staticmethod
    def _kth(rough: np.ndarray, k: int) -> np.ndarray:
        return np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.zeros(len(rough))

    def _exactly(self, t: np.ndarray, w: np.ndarray, near: np.ndarray, k: int, full: np.ndarray) -> list[tuple[int, float]]:
        if not len(near):
            return []
        full[t] = w
        at, sizes = _spans(self.starts[near], self.sizes[near]), self.sizes[near]
        cos = np.round(np.add.reduceat(full[self.t[at]] * self.w[at], np.cumsum(sizes) - sizes), 12)
        full[t] = 0
        best = np.lexsort((self.ids[near], -cos))[:k]
        return [(int(near[i]), float(cos[i])) for i in best.tolist() if cos[i] > 0]

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Share of toxic weight among the neighbours; -1 without any."""
        if not near:
            return -1.0
        at = [i for i, _ in near]
        w = np.array([s for _, s in near]) * self.weights[at]
        return float((w * self.labels[at]).sum() / w.sum())

    def calibrate(self, k: int, alone: np.ndarray) -> None:
        """Monotone map from votes to probabilities (pooled neighbours). ``alone``:
        the example has no copy that would be found without it."""
        votes = np.array([self.vote(near) for near in self.nearest_all(self.vectors, k, leave_out=alone)])
        pools: list[list[float]] = []  # toxic weight, weight, smallest and largest vote
        for v in np.unique(votes):
            m = votes == v
            pools.append([float((self.weights * self.labels)[m].sum()), float(self.weights[m].sum()), float(v), float(v)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a, n, _, v2 = pools.pop()
                pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2], v2]
        self.votes = np.array([v for p in pools for v in p[2:]])
        self.values = np.array([p[0] / p[1] for p in pools for _ in p[2:]])

    def score(self, near: list[tuple[int, float]]) -> float:
        # Between the votes of two pools, in proportion.
        return float(min(1.0, max(0.0, np.interp(self.vote(near), self.votes, self.values))))


def pick(marked: DataFrame, n: dict[int, int], max_rows: int) -> DataFrame:
    """(i, y, h): at most ``max_rows`` rows of each class, smallest hash first. A
    threshold on the hash leaves few more than these before anything is sorted."""
    h = F.xxhash64("i")
    out = None
    for y in sorted(n):
        share = min(1.0, (max_rows + 6 * max_rows ** 0.5) / n[y])
        part = (marked.where((F.col("y") == y) & (F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))))
                .withColumn("h", F.pmod(h, F.lit(1 << 30))).orderBy("h", "i").limit(max_rows))
        out = part if out is None else out.unionByName(part)
    return out


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", max_rows: int = 10_000, max_examples: int = 1000,
        max_bytes: int = 64 << 20, min_chi2: float = 20.0, k: int = 15) -> ExampleIndex | None:
    """The index over labelled examples; None if a class has none. ``learnable``
    is a condition on the id column."""
    marked = (labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("i").isNotNull() & F.col("y").isin(0, 1)).groupBy("i").agg(F.max("y").alias("y")))
    if learnable is not None:
        marked = marked.withColumnRenamed("i", id_col).where(learnable).withColumnRenamed(id_col, "i")
    docs_t = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    th = F.xxhash64(F.coalesce("t", F.lit("")))
    # Copies are one text, whatever their number.
    marked = marked.join(docs_t.select("i", th.alias("th")), "i").groupBy("i", "y").agg(F.min("th").alias("th"))
    marked = materialize(marked.groupBy("y", "th").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("copies")), "labels")
    sums = marked.groupBy("y").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts")).collect()
    n, texts = {r["y"]: r["n"] for r in sums}, {r["y"]: r["texts"] for r in sums}
    if not n.get(0) or not n.get(1):
        return None
    # At most 2 * max_rows ids and labels are sent out.
    chosen = pick(marked.select("i", "y", "th", (F.col("copies") == 1).alias("alone")), texts, max_rows)
    rows = (docs_t.withColumn("th", th).join(F.broadcast(chosen), ["i", "th"])
            .groupBy("i", "y", "h", "alone").agg(F.min("t").alias("t")))
    rows = materialize(rows, "labelled")
    sizes = (rows.select("i", "y", "h", F.octet_length(F.coalesce("t", F.lit(""))).alias("bytes"))
             .orderBy("y", "h", "i").toArrow().to_pylist())  # a row for each text learned from
    have = {y: sum(r["y"] == y for r in sizes) for y in (0, 1)}
    ex = []
    for y in (0, 1):
        left = max_bytes // 2
        for r in [r for r in sizes if r["y"] == y][:max_examples]:
            if r["bytes"] <= left:
                left -= r["bytes"]
                ex.append((r["i"], True))
    ex = rows.sparkSession.createDataFrame(ex, "i long, e boolean")  # at most 2 * max_examples ids
    rows = rows.join(F.broadcast(ex), "i", "left").fillna(False, "e")
    rows = materialize(rows, "examples")
    counts = class_counts(rows, "t", "y", "e").toArrow().sort_by("term")  # a row a term
    terms = counts["term"].to_pylist()
    marks = mark_weights(counts["toxic"].to_numpy(), counts["clean"].to_numpy(), have[1], have[0], min_chi2)
    total, df = document_frequencies(docs, text_col, terms)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = TermSpace(terms)
        for b in batches:
            got = [space.counts(t) for t in b["t"]]
            yield pd.DataFrame({"i": b["i"], "y": b["y"], "alone": b["alone"], "at": [t.astype(np.int32).tobytes() for t, _ in got],
                                "n": [n.astype(np.int32).tobytes() for _, n in got]})

    # At most 2 * max_examples rows with the counts of their terms.
    ex = map_slices(rows.where("e").select("i", "y", "alone", "t"), vectors,
                    "i long, y int, alone boolean, at binary, n binary").toArrow().sort_by("i")
    y = ex["y"].to_numpy().astype(np.float64)
    share = {c: n[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    held = [(np.frombuffer(t.as_buffer(), np.int32), np.frombuffer(m.as_buffer(), np.int32))
            for t, m in zip(ex["at"], ex["n"], strict=True)]
    index = ExampleIndex(terms, idf * marks, ex["i"].to_numpy(), y, held, np.where(y == 1, share[1], share[0]))
    index.calibrate(k, ex["alone"].to_numpy(zero_copy_only=False)[index.order])
    return index


def score(docs: DataFrame, index: ExampleIndex | None, text_col: str = "text", k: int = 15) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (nearest examples: id, label,
    cosine); they replace columns of those names."""
    kind = "score double, evidence array<struct<doc_id: long, label: int, cosine: double>>"
    if index is None:
        return docs.withColumns({"score": F.lit(0.0), "evidence": F.array().cast(kind.split(" ", 3)[3])})
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def rate(texts: pd.Series) -> pd.DataFrame:
        x = sent.value
        out = []
        for near in x.nearest_all([x.vector(x.space.counts(t)) for t in texts], k):
            out.append((x.score(near), [{"doc_id": int(x.ids[i]), "label": int(x.labels[i]), "cosine": s} for i, s in near]))
        return pd.DataFrame(out, columns=["score", "evidence"])

    return add_columns(docs, [text_col], rate, kind)
