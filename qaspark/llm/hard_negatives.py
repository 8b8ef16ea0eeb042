"""Hard-negative mining over an inverted multi-index (operator 12).

Vectors of whole numbers are cut into two halves. Each half has a codebook (k-means
on at most ``sample_rows`` vectors, chosen by a hash of their id); a cell is a pair
of codes and holds the vectors whose halves are nearest to them, in blocks of at
most some ``BLOCK_ROWS`` rows, so a cell of copies is many tasks.

The score of an anchor with any vector of a cell is at most
``a1.c1 + |a1| r1 + a2.c2 + |a2| r2`` with the radii ``r`` of the halves' codes.
A heap over the two sorted lists of half scores (multi-sequence) hands out the
cells by this sum, falling. What is searched is a window of scores: for the
positives all scores of the anchor's label, for the negatives of a positive the
scores between two shares of the positive's. Each is searched in two rounds:

1. the first ``probe`` cells give a lower bound, the k-th best score seen;
2. the walk goes on until the next cell's sum lies below that bound. What was seen is
   then certified. A cell whose own radii show that it holds nothing of a
   window, because all its scores are below the bound or above the window, is
   passed over.

So the result is exact, whatever the codebooks; only the work depends on them. Anchors
near each other walk together, in groups of some ``GROUP`` anchors, and a block of
vectors is compared with all anchors of a group in one product. Scores are sums
of products of whole numbers and exact in doubles.

Defined results: rows with a null id, label or vector, an entry that is null or of
magnitude ``TOP`` or more, and vectors not as long as most take no part; an id with several
rows counts with its smallest label and vector; ties go to the smaller id; an
anchor without another row of its label has no positive and no row; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.ann import k_means
from qaspark.llm.common import materialize

#: Rows of a block, anchors of a group, and rows a cell should have.
BLOCK_ROWS, GROUP, CELL_ROWS = 1024, 512, 512
#: Codes of a half, at most.
MAX_CODES = 128
#: Magnitude from which an entry is not used, and the widest vectors: sums of
#: products stay below 2^52.
TOP, MAX_WIDTH = 1 << 20, 4096
_SLACK = 1e-6


class Codes:
    """Both codebooks, and what the cells hold: blocks and radii of the halves."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 12):
        rng = np.random.RandomState(seed)
        self.cut = (sample.shape[1] + 1) // 2
        self.books = [k_means(h, k, rng) if h.shape[1] else np.zeros((1, 0)) for h in self.halves(sample)]
        self.shape = tuple(len(b) for b in self.books)
        self.blocks = np.zeros(self.shape, np.int64)
        self.radii = [np.zeros(self.shape), np.zeros(self.shape)]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut].astype(np.float64), x[:, self.cut:].astype(np.float64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell number of each vector and the distances of its halves from the codes."""
        codes, far = [], []
        for half, book in zip(self.halves(x), self.books, strict=True):
            near = ((book * book).sum(axis=1) - 2 * half @ book.T).argmin(axis=1)
            codes.append(near)
            far.append(np.sqrt(((half - book[near]) ** 2).sum(axis=1)))
        return codes[0] * self.shape[1] + codes[1], np.stack(far, axis=1)

    def bounds(self, anchors: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For each anchor: the largest half scores by code, and the largest and the
        smallest score in each cell."""
        dots, sizes = [], []
        for half, book in zip(self.halves(anchors), self.books, strict=True):
            dots.append(half @ book.T)
            sizes.append(np.sqrt((half * half).sum(axis=1)))
        held = self.blocks > 0
        most = [np.where(held, r, -np.inf).max(axis=1 - i) for i, r in enumerate(self.radii)]
        for i in range(len(anchors)):
            tops = [dots[h][i] + sizes[h][i] * np.maximum(most[h], 0) for h in (0, 1)]
            mid = dots[0][i][:, None] + dots[1][i][None, :]
            reach = sizes[0][i] * self.radii[0] + sizes[1][i] * self.radii[1]
            slack = _SLACK * (1 + np.abs(mid) + reach)
            yield tops, np.where(held, mid + reach + slack, -np.inf), np.where(held, mid - reach - slack, np.inf)


def by_falling_sum(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of two lists, by falling sum."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    queue = [(-(x[0] + y[0]), 0, 0)]
    while queue:
        s, i, j = heapq.heappop(queue)
        yield -s, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(queue, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(queue, (-(x[i + 1] + y[0]), i + 1, 0))


def walk(tops: list, high: np.ndarray, low: np.ndarray, least: np.ndarray, most: np.ndarray, probe: int,
         rest: bool) -> list[tuple[int, int]]:
    """Cells that an anchor visits for its windows (scores ``least`` to ``most``
    each): the first ``probe`` of the walk, or the ``rest`` of it."""
    out, seen = [], 0
    stop = least.min()
    for bound, i, j in by_falling_sum(*tops):
        if bound + _SLACK * (1 + abs(bound)) < stop:
            break
        if low[i, j] == np.inf:  # an empty cell
            continue
        seen += 1
        if seen > probe and not rest:
            break
        if (seen > probe) == rest and ((high[i, j] >= least) & (low[i, j] <= most)).any():
            out.append((i, j))
    return out


def valid_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x): one row for each id."""
    x = F.col(vector_col).cast("array<long>")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < TOP, F.lit(False)))
    held = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine))
    return held.groupBy("id").agg(F.min(F.struct("label", F.col("x").cast("array<int>").alias("x"))).alias("r")).select("id", "r.*")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.int32)


_BLOCK = "cell int, blk int, ids binary, labels binary, x binary"


class MultiIndex:
    """The codes, the blocks of vectors (``_BLOCK``) and the anchors
    (id, label, x, grp)."""

    def __init__(self, codes: Codes, blocks: DataFrame, anchors: DataFrame, probe: int):
        self.codes, self.blocks, self.anchors, self.probe = codes, blocks, anchors, probe


def build(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str = "label", sample_rows: int = 20_000, codes: int | None = None) -> MultiIndex | None:
    """The index over the valid rows; ``anchors`` is a condition on ``id``. None
    without a valid row."""
    spark = rows.sparkSession
    held = materialize(valid_rows(rows, id_col, vector_col, label_col), "mine-rows")
    most = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    if most["d"] > MAX_WIDTH:
        raise ValueError(f"vectors of {most['d']} entries; at most {MAX_WIDTH} are possible")
    held = held.where(F.size("x") == most["d"])
    k = codes or int(min(MAX_CODES, max(2, np.ceil(np.sqrt(most["count"] / CELL_ROWS)))))
    # At most sample_rows vectors.
    sample = held.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("x").toPandas()
    book = Codes(_matrix(sample["x"]), k)
    sent = spark.sparkContext.broadcast(book)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, far = sent.value.place(_matrix(f["x"])) if len(f) else (np.empty(0, np.int32), np.empty((0, 2)))
            yield f.assign(cell=cell.astype(np.int32), r1=far[:, 0], r2=far[:, 1])

    placed = materialize(held.mapInPandas(place, "id long, label long, x array<int>, cell int, r1 double, r2 double"), "mine-placed")
    asked = F.coalesce(anchors, F.lit(False))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"),
                                       F.count_if(asked).alias("asks")).orderBy("cell").collect()  # a row for each cell
    starts, start = [], 0
    for r in cells:
        at = divmod(r["cell"], book.shape[1])
        book.blocks[at] = -(-r["n"] // BLOCK_ROWS)
        book.radii[0][at], book.radii[1][at] = r["r1"], r["r2"]
        starts.append((r["cell"], int(book.blocks[at]), start, max(1, r["asks"])))
        start += r["asks"]
    per_cell = F.broadcast(spark.createDataFrame(starts, "cell int, nb int, start long, asks long"))
    known = placed.drop("r1", "r2").join(per_cell, "cell")

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        return pd.DataFrame({"cell": [key[0]], "blk": [key[1]], "ids": [f["id"].to_numpy(np.int64).tobytes()],
                             "labels": [f["label"].to_numpy(np.int64).tobytes()], "x": [_matrix(f["x"]).tobytes()]})

    blocks = (known.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
              .groupBy("cell", "blk").applyInPandas(pack, _BLOCK))
    # Anchors of neighbouring cells share a group.
    spot = F.col("start") + F.pmod(F.xxhash64(F.lit(2), "id"), F.col("asks"))
    ask = known.where(asked).select("id", "label", "x", F.floor(spot / GROUP).cast("int").alias("grp"))
    return MultiIndex(book, materialize(blocks, "mine-blocks"), materialize(ask, "mine-anchors"),
                      probe=max(4, len(cells) // 16))


_ASK = "cell int, blk int, who binary, kinds binary, a binary, least binary, most binary"


def asks(index: MultiIndex, windows: DataFrame, width: int, rest: bool) -> DataFrame:
    """(``_ASK``): for each block, the anchors of a group that visit it. ``windows``:
    (id, least, most), arrays of ``width`` scores for each anchor that still searches."""
    sent = index.anchors.sparkSession.sparkContext.broadcast((index.codes, index.probe))

    def visit(f: pd.DataFrame) -> pd.DataFrame:
        codes, probe = sent.value
        x = _matrix(f["x"])
        least, most = np.stack(f["least"].to_list()).astype(np.int64), np.stack(f["most"].to_list()).astype(np.int64)
        visitors: dict[tuple[int, int], list[int]] = {}
        for n, (tops, high, low) in enumerate(codes.bounds(x)):
            for at in walk(tops, high, low, least[n], most[n], probe, rest):
                visitors.setdefault(at, []).append(n)
        ids, labels = f["id"].to_numpy(np.int64), f["label"].to_numpy(np.int64)
        out = []
        for (i, j), who in visitors.items():
            payload = (ids[who].tobytes(), labels[who].tobytes(), x[who].tobytes(), least[who].tobytes(), most[who].tobytes())
            out += [(i * codes.shape[1] + j, b, *payload) for b in range(int(codes.blocks[i, j]))]
        return pd.DataFrame(out, columns=["cell", "blk", "who", "kinds", "a", "least", "most"])

    return index.anchors.join(windows, "id").groupBy("grp").applyInPandas(visit, _ASK)


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores that fit in each row; of equal ones the
    first columns."""
    span = 1 << max(1, int(scores.shape[1] - 1).bit_length())
    key = np.where(fits, scores * span + (span - 1 - np.arange(scores.shape[1])), np.iinfo(np.int64).min)
    if key.shape[1] > k:
        at = np.argpartition(key, key.shape[1] - k, axis=1)[:, -k:]
    else:
        at = np.broadcast_to(np.arange(key.shape[1]), key.shape)
    row = np.repeat(np.arange(len(key)), at.shape[1])
    col = at.ravel()
    live = fits[row, col]
    return row[live], col[live]


_FOUND = "anchor_id long, w int, id long, score long"


def compare(index: MultiIndex, asked: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(``_FOUND``): of each block, the k best rows of each window of its visitors."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An explicit number of partitions: few rows, much work in each.
    both = asked.repartition(parts, "cell", "blk").join(index.blocks.repartition(parts, "cell", "blk"), ["cell", "blk"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                who, kinds = np.frombuffer(r.who, np.int64), np.frombuffer(r.kinds, np.int64)
                ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
                a = np.frombuffer(r.a, np.int32).reshape(len(who), -1).astype(np.float64)
                x = np.frombuffer(r.x, np.int32).reshape(len(ids), -1).astype(np.float64)
                s = np.rint(a @ x.T).astype(np.int64)
                least = np.frombuffer(r.least, np.int64).reshape(len(who), width)
                most = np.frombuffer(r.most, np.int64).reshape(len(who), width)
                fits = ((kinds[:, None] == labels) == same_label) & (who[:, None] != ids)
                for w in range(width):
                    row, col = best(s, fits & (s >= least[:, w:w + 1]) & (s <= most[:, w:w + 1]), k)
                    yield pd.DataFrame({"anchor_id": who[row], "w": np.int32(w), "id": ids[col], "score": s[row, col]})

    return both.mapInPandas(score, _FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


#: Bounds of a window that all scores lie in, and of one that none lies in.
_FREE, _NONE = (-(1 << 53), 1 << 53), (1 << 53, -(1 << 53))


def search(index: MultiIndex, windows: DataFrame, width: int, k: int, same_label: bool, name: str) -> DataFrame:
    """(``_FOUND``, rank): the exact k best rows of each window, in two rounds."""
    first = materialize(top(compare(index, asks(index, windows, width, False), width, k, same_label), k), f"mine-{name}-1")
    # The k-th score seen so far takes the place of the window's lower end.
    kth = first.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    raised = windows.join(kth, "id", "left").withColumn("least", F.transform("least", lambda x, i: F.greatest(
        x, F.coalesce(F.try_element_at("kth", i), x)))).drop("kth")
    rest = compare(index, asks(index, raised, width, True), width, k, same_label)
    return materialize(top(first.drop("rank").unionByName(rest), k), f"mine-{name}")


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, codes: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each anchor (``anchors``, a condition on ``id``) and each of its
    ``n_positive`` best rows of its label, the ``n_negative`` best rows of other
    labels with ``low`` to ``high`` percent of the positive's score. Vectors hold whole numbers."""
    spark = rows.sparkSession
    index = build(rows, anchors, id_col, vector_col, label_col, codes=codes)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def fixed(bound: int) -> Column:
        return F.array(F.lit(bound).cast("long"))

    free = index.anchors.select("id", fixed(_FREE[0]).alias("least"), fixed(_FREE[1]).alias("most"))
    positives = search(index, free, 1, n_positive, True, "positives")
    # 100 negative >= low positive and 100 negative <= high positive, in whole numbers.
    p = F.col("score")
    least = -F.expr(f"(-{low} * score) div 100 - if((-{low} * score) % 100 < 0, 1, 0)")
    most = F.expr(f"({high} * score) div 100 - if(({high} * score) % 100 < 0, 1, 0)")
    per = (positives.select("anchor_id", "rank", least.cast("long").alias("least"), most.cast("long").alias("most"))
           .groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(
               F.struct("rank", F.struct("least", "most")))).alias("m")))
    ranks = [F.try_element_at("m", F.lit(i + 1)) for i in range(n_positive)]
    windows = per.select("id", F.array(*[F.coalesce(r["least"], F.lit(_NONE[0]).cast("long")) for r in ranks]).alias("least"),
                         F.array(*[F.coalesce(r["most"], F.lit(_NONE[1]).cast("long")) for r in ranks]).alias("most"))
    negatives = search(index, materialize(windows, "mine-windows"), n_positive, n_negative, False, "negatives")
    pos = positives.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), p.alias("positive_score"))
    return (negatives.join(pos, ["anchor_id", "w"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
