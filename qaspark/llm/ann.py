"""Approximate nearest neighbours with a hierarchical k-means tree (operator 7).

The tree is fitted on at most ``sample_rows`` vectors of unit length, chosen by
a hash of their id: each node's vectors are split by k-means into ``branching``
children until ``leaf_rows`` are left. Every valid vector of the table is put
into the leaf that greedy descent reaches, and leaves are cut into blocks of
bounded size, so a vector that fills a leaf with copies is many tasks.

A query walks the tree best bin first: a priority queue holds the children not
yet entered by distance to their centre, and the nearest is entered next, so
leaves come out in the order in which they are visited. How many are visited is
calibrated: the exact neighbours of ``calibration`` sampled vectors are found by
brute force over the whole table in blocks, and the visits are widened until
the leaves hold the wanted share of them. Each block compares its vectors with
the queries that visit it and hands on the best ``k`` per query.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors not as long as most of the sample, take no part;
rows without an id take no part; repeated rows are candidates each, and an id with several
vectors asks with the smallest of them (by entries); ties go to the
smaller id; fewer than ``k`` candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import materialize


#: Rows of a leaf compared in one task.
BLOCK_ROWS = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def k_means(x: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 12) -> np.ndarray:
    """Centres; starts are drawn far from each other (k-means++)."""
    centres = [x[rng.randint(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 1e-12:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


class KMeansTree:
    """Nodes as arrays: centre, children (empty for a leaf), leaf number."""

    def __init__(self, sample: np.ndarray, branching: int, leaf_rows: int, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.dim = sample.shape[1]
        self.centres, self.children, self.leaf = [np.zeros(self.dim)], [np.empty(0, np.int64)], [-1]
        self.n_leaves = 0
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop()
            c = k_means(x, branching, rng) if len(x) > leaf_rows else x[:0]
            if len(c) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            kids = []
            for i in range(len(c)):
                kids.append(len(self.centres))
                self.centres.append(c[i])
                self.children.append(np.empty(0, np.int64))
                self.leaf.append(-1)
                todo.append((kids[-1], x[near == i]))
            self.children[node] = np.array(kids)
        self.centres = np.array(self.centres)

    def _distances(self, node: int, v: np.ndarray) -> np.ndarray:
        c = self.centres[self.children[node]]
        return ((c * c).sum(axis=1) - 2 * c @ v) + 1.0  # squared, v has length 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector by greedy descent."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[at] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = ((c * c).sum(axis=1)[None, :] - 2 * x[at] @ c.T).argmin(axis=1)
            todo += [(int(kids[i]), at[near == i]) for i in range(len(kids)) if (near == i).any()]
        return out

    def leaves(self, v: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of a best-bin-first walk."""
        out: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(out) < visits:
            node = heapq.heappop(queue)[1]
            while len(self.children[node]):
                d, kids = self._distances(node, v), self.children[node]
                best = int(d.argmin())
                for i in range(len(kids)):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), int(kids[i])))
                node = int(kids[best])
            out.append(self.leaf[node])
        return out


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of finite components that are not all zero."""
    v = F.col(vector_col).cast("array<double>")
    top = float(np.finfo(np.float64).max)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= top), F.lit(False)))
    return (rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.to_list(), np.float64)


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of the k nearest rows of each query but itself."""
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / qn[:, None]) @ (x / xn[:, None]).T
    rough[q_ids[:, None] == x_ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        r = rough[i]
        least = np.partition(r, -k)[-k] if len(r) > k else -2.0
        at = np.flatnonzero((r >= max(least, -2.0) - 1e-9) & (r > -np.inf))
        # Exactly, and the same whatever block a row is in.
        cos = (x[at] * q[i]).sum(axis=1) / (xn[at] * qn[i])
        for j in np.lexsort((x_ids[at], -cos))[:k].tolist():
            out.append((int(q_ids[i]), int(x_ids[at[j]]), float(cos[j])))
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Index:
    """A fitted tree, the table of vectors by leaf, and the calibrated visits."""

    def __init__(self, tree: KMeansTree, rows: DataFrame, blocks: np.ndarray, visits: int, recall: float):
        self.tree, self.rows, self.blocks, self.visits, self.recall = tree, rows, blocks, visits, recall


_FOUND = "query_id long, vec_id long, score double"


def exact_neighbours(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Nearest rows of a bounded set of queries by brute force, in blocks."""
    q, ids = _matrix(queries["v"]), queries["id"].to_numpy(np.int64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(_best(q, ids, _matrix(b["v"]), b["id"].to_numpy(np.int64), k),
                               columns=["query_id", "vec_id", "score"])

    return _top(rows.select("id", "v").mapInPandas(scan, _FOUND), k)


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          recall: float = 0.97, sample_rows: int = 20_000, branching: int = 8, leaf_rows: int = 64,
          calibration: int = 200) -> Index | None:
    """Fit, fill and calibrate; None without a valid vector."""
    good = valid_vectors(rows, id_col, vector_col)
    sample = good.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    if not len(sample):
        return None
    sizes = sample["v"].map(len)
    dim = int(sizes.mode().iloc[0])
    tree = KMeansTree(_unit(_matrix(sample["v"][sizes == dim])), branching, leaf_rows)
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=sent.value.assign(_unit(_matrix(b["v"]))) if len(b) else np.empty(0, np.int32))

    filled = materialize(good.where(F.size("v") == dim).mapInPandas(place, "id long, v array<double>, leaf int"), "ann")
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in filled.groupBy("leaf").count().collect():  # a row per leaf
        counts[r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))

    probe = filled.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(calibration).toPandas()
    truth = (exact_neighbours(filled, probe, k)
             .join(filled.select(F.col("id").alias("vec_id"), "leaf").distinct(), "vec_id").toPandas())
    unit = dict(zip(probe["id"], _unit(_matrix(probe["v"])), strict=True))
    order = {i: {leaf: n for n, leaf in enumerate(tree.leaves(v, tree.n_leaves))} for i, v in unit.items()}
    depth = np.sort([order[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    visits = 1 + int(depth[max(0, int(np.ceil(recall * len(depth))) - 1)]) if len(depth) else 1
    reached = float((depth < visits).mean()) if len(depth) else 1.0
    return Index(tree, filled, blocks, visits, reached)


def in_blocks(asked: DataFrame, rows: DataFrame, blocks: np.ndarray, bound: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Queries (a row per visited leaf) and vectors dealt over (leaf, qb, block):
    about ``bound`` queries or vectors of a leaf each, and all pairs of blocks."""
    spark = rows.sparkSession
    per_leaf = [(r["leaf"], int(blocks[r["leaf"]]), -(-r["count"] // bound))
                for r in asked.groupBy("leaf").count().collect()]  # a row per leaf
    per_leaf = F.broadcast(spark.createDataFrame(per_leaf, "leaf int, nb int, nq int"))
    asked = (asked.join(per_leaf, "leaf").withColumn("qb", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("nq")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq"))
    held = (rows.join(per_leaf, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nb", "nq"))
    return asked, held


def search(index: Index, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the indexed rows that meet the
    condition ``queries`` on ``id``."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((index.tree, index.visits))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, visits = sent.value
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at:at + 64]
                rows = [(i, v, leaf) for i, v, u in zip(part["id"], part["v"], _unit(_matrix(part["v"])), strict=True)
                        for leaf in tree.leaves(u, visits)]
                yield pd.DataFrame(rows, columns=["id", "v", "leaf"])

    # An explicit number of partitions: few rows, much work in each.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = index.rows.where(queries).groupBy("id").agg(F.min("v").alias("v")).repartition(parts, "id")
    asked = materialize(once.mapInPandas(walk, "id long, v array<double>, leaf int"), "visits")
    asked, held = in_blocks(asked, index.rows, index.blocks)

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        xs, x_ids = _matrix(x["v"]), x["id"].to_numpy(np.int64)
        out = []
        for at in range(0, len(q), 512):
            part = q.iloc[at:at + 512]
            out += _best(_matrix(part["v"]), part["id"].to_numpy(np.int64), xs, x_ids, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = asked.groupBy("leaf", "qb", "block").cogroup(held.groupBy("leaf", "qb", "block")).applyInPandas(compare, _FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
