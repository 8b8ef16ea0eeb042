"""Exact nearest neighbours in large clusters, without comparing all pairs.

A cluster's members are dealt to cells around pivots (members drawn by a hash of the token);
each cell knows its radius. On vectors of length one the cosine distance is half the
squared Euclidean one, so by the triangle inequality no member of a cell is nearer to a
query than ``(|q - pivot| - radius)^2 / 2``. A first round asks the cell of a query's nearest
pivot; its k-th distance is a bound that excludes cells, and the second round asks all others. The first
is the blocked search of :mod:`qaspark.operators.neighbors` with the cell as
group, so hot cells are split. In the second a block of queries meets a block of whole cells and
their pivots: a query travels once for each block of cells, however many cells it has to visit, and a task
asks only the cells that the bounds leave. Results do not depend on the pivots; only the share of
cells that is excluded does, and :meth:`Search.visited` counts it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.operators import neighbors as NB
from qaspark.session import materialize

#: Members of a cell on average, and pivots of one cluster that a task holds at most in the mean
#: (larger clusters get larger cells).
CELL_ROWS, MAX_PIVOTS = 1024, 4096
#: Candidates that a task of the second round holds before it keeps the best of each query.
HELD_ROWS = 1 << 19
_FRACTION = 1 << 30


def _norm(c: str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))


def _unit(df: DataFrame, c: str) -> DataFrame:
    """Rows with ``c`` of length one; null, zero and non-finite vectors have no distance and go."""
    df = df.withColumn("_n", _norm(c)).where((F.col("_n") > 0) & (F.col("_n") < F.lit(float("inf"))))
    return df.withColumn(c, F.transform(c, lambda x: x / F.col("_n"))).drop("_n")


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ p.T), 0.0))


def _nearest_pivot(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest pivot of each row, the first among equals."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    for tile in NB._tiles(len(x), len(p)):
        d = _distances(x[tile], p)
        at[tile] = d.argmin(axis=1)
        far[tile] = d[np.arange(len(d)), at[tile]]
    return at, far


def _open_cells(x: np.ndarray, p: np.ndarray, radius: np.ndarray, bound: np.ndarray, slack: float) -> np.ndarray:
    """Whether the bounds leave a cell (column) open to a query (row)."""
    least = np.maximum(_distances(x, p) - radius - 1e-7, 0.0)
    return least ** 2 / 2 <= (bound + slack)[:, None]


def _meet(rows: DataFrame, pivots: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(rows, pivots)`` on evenly sized parts of a cluster's rows, each with all its pivots."""
    width = pivots.select(F.size("pvec").alias("d")).first()
    size = NB._block_rows(width["d"] if width else 1)
    parts = NB._chunks(rows, "label", size, "_parts").withColumnRenamed("label", "_label")
    dealt = (rows.join(parts, F.col("label").eqNullSafe(F.col("_label")))
             .withColumn("part", F.pmod(F.xxhash64(rows.columns[0]), F.col("_parts")).cast("int")).drop("_label", "_parts"))
    sent = (pivots.join(parts, F.col("label").eqNullSafe(F.col("_label")))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1))).drop("_label", "_parts"))

    def both(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if x.empty or p.empty:
            return pd.DataFrame({c.strip().split(" ")[0]: [] for c in schema.split(",")})
        return run(x, p.sort_values("cell", kind="stable"))

    return dealt.groupBy("label", "part").cogroup(sent.groupBy("label", "part")).applyInPandas(both, schema)


@dataclass
class Cells:
    members: DataFrame  # (token, label, vec, cell), vectors of length one
    pivots: DataFrame   # (label, cell, pvec, radius)


def build(members: DataFrame, cell_rows: int = CELL_ROWS) -> Cells:
    """Cells of ``members`` ``(token, label, vec)``. A null label is no cluster."""
    unit = materialize(_unit(members.select("token", "label", F.col("vec").cast("array<double>").alias("vec"))
                             .where(F.col("label").isNotNull() & F.col("token").isNotNull()), "vec"), "pivot-members")
    drawn = F.pmod(F.xxhash64("token"), F.lit(_FRACTION))
    sizes = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least"))
    want = F.least(F.ceil(F.col("n") / cell_rows), F.lit(MAX_PIVOTS)) / F.col("n") * _FRACTION
    chosen = unit.join(sizes, "label").where((drawn < want) | (drawn == F.col("least")))
    pivots = materialize(chosen.groupBy("label", "token").agg(F.min("vec").alias("pvec"))
                         .select("label", F.to_json(F.struct("label", "token")).alias("cell"), "pvec"), "pivots")

    def deal(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        at, far = _nearest_pivot(NB._matrix(x["vec"]), NB._matrix(p["pvec"]))
        return pd.DataFrame({"token": x["token"].to_numpy(), "label": x["label"].to_numpy(), "vec": x["vec"].to_numpy(),
                             "cell": p["cell"].to_numpy()[at], "far": far})

    kind = unit.schema["label"].dataType.simpleString()
    dealt = materialize(_meet(unit, pivots, deal, f"token string, label {kind}, vec array<double>, cell string, far double"),
                        "pivot-cells")
    radius = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    return Cells(dealt.drop("far"), materialize(pivots.join(radius, "cell"), "pivot-radii"))


@dataclass
class Search:
    rows: DataFrame    # (qtoken, rank, token, dist)
    visits: DataFrame  # (qtoken, label, cell): visits of both rounds
    cells: Cells
    queries: DataFrame

    def visited(self) -> DataFrame:
        """One row: pairs of a query and a cell of its cluster, how many were visited, and the same for
        pairs of a query and a member."""
        per = self.cells.pivots.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"))
        total = self.queries.join(per, "label").agg(F.sum("c").alias("cell_pairs"), F.sum("m").alias("member_pairs"))
        n = self.cells.pivots.select("cell", "n")
        seen = self.visits.join(n, "cell").agg(F.count(F.lit(1)).alias("cells_visited"), F.sum("n").alias("members_visited"))
        return total.join(seen)  # one row each


def topk_pruned(queries: DataFrame, members: DataFrame, k: int = NB.TOP, decimals: int = 6,
                cell_rows: int = CELL_ROWS) -> Search:
    """The result of :func:`neighbors.topk_in_group` by cells and bounds: the exact ``k``
    nearest members of each query's cluster, ties by rounded distance, then token."""
    cells = build(members, cell_rows)
    asked = materialize(_unit(queries.select("qtoken", "label", F.col("qvec").cast("array<double>").alias("qvec"))
                              .where(F.col("label").isNotNull() & F.col("qtoken").isNotNull()), "qvec"), "pivot-queries")
    kind = asked.schema["label"].dataType.simpleString()
    visit = f"qtoken string, label {kind}, cell string, qvec array<double>"

    def home(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        at, _ = _nearest_pivot(NB._matrix(x["qvec"]), NB._matrix(p["pvec"]))
        return pd.DataFrame({"qtoken": x["qtoken"].to_numpy(), "label": x["label"].to_numpy(),
                             "cell": p["cell"].to_numpy()[at], "qvec": x["qvec"].to_numpy()})

    # Rounded distances tie up to half a unit of the last place further away.
    slack = 10.0 ** -decimals + 1e-9

    def others(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        q, pv, radius, bound = NB._matrix(x["qvec"]), NB._matrix(p["pvec"]), p["radius"].to_numpy(), x["bound"].to_numpy()
        cell, own = p["cell"].to_numpy(), x["cell"].to_numpy()
        pairs = []
        for tile in NB._tiles(len(q), len(pv)):
            i, j = np.nonzero(_open_cells(q[tile], pv, radius, bound[tile], slack) & (own[tile][:, None] != cell[None, :]))
            pairs.append((i + tile.start, j))
        i, j = (np.concatenate(c) for c in zip(*pairs))
        return pd.DataFrame({"qtoken": x["qtoken"].to_numpy()[i], "label": x["label"].to_numpy()[i], "cell": cell[j]})

    held = cells.members.select("token", F.col("cell").alias("label"), "vec")

    first = materialize(_meet(asked, cells.pivots, home, visit), "pivot-home")
    near = materialize(NB.topk_in_group(first.select("qtoken", F.col("cell").alias("label"), "qvec"), held, k, decimals=decimals), "pivot-near")
    bound = near.where(F.col("rank") == k).select("qtoken", F.col("dist").alias("bound"))
    known = materialize(first.join(bound, "qtoken", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "pivot-known")
    second = _second_round(known, cells, k, decimals, slack)
    w = Window.partitionBy("qtoken").orderBy("dist", "token")  # at most k rows a query and block
    rows = (near.drop("rank").unionByName(second)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qtoken", "rank", "token", "dist"))
    visits = _meet(known, cells.pivots, others, f"qtoken string, label {kind}, cell string")  # runs only where it is counted
    return Search(rows, first.drop("qvec").unionByName(visits), cells, asked)


def _second_round(known: DataFrame, cells: Cells, k: int, decimals: int, slack: float) -> DataFrame:
    """``(qtoken, token, dist)``: the nearest members of each query in the cells other than its own that its bound
    leaves open. Blocks of queries meet blocks of cells; a cell beyond a block's size is dealt to several."""
    width = cells.pivots.select(F.size("pvec").alias("d")).first()
    size = NB._block_rows(width["d"] if width else 1)
    sizes = (NB._chunks(cells.members, "label", size, "n_m").join(NB._chunks(known, "label", size, "n_q"), "label")
             .select(F.col("label").alias("_label"), "n_m", "n_q"))  # one row a cluster
    big = F.ceil(F.col("n") / F.lit(size)).cast("int")

    def block(part) -> Column:
        return F.pmod(F.xxhash64("cell", part), F.col("n_m")).cast("int").alias("mb")

    p = (cells.pivots.join(sizes, F.col("label") == F.col("_label")).withColumn("part", F.explode(F.sequence(F.lit(0), big - 1)))
         .select("label", block(F.col("part")), "n_q", "cell", F.lit(None).cast("string").alias("token"), F.col("pvec").alias("vec"), "radius").distinct())
    parts = cells.pivots.select(F.col("cell").alias("_cell"), big.alias("_parts"))
    m = (cells.members.join(sizes, F.col("label") == F.col("_label")).join(parts, F.col("cell") == F.col("_cell"))
         .select("label", block(F.pmod(F.xxhash64("token"), F.col("_parts")).cast("int")), "n_q", "cell", "token", "vec",
                 F.lit(None).cast("double").alias("radius")))
    held = m.unionByName(p).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_q").cast("int") - 1))).drop("n_q")
    q = (known.join(sizes, F.col("label") == F.col("_label"))
         .withColumn("qb", F.pmod(F.xxhash64("qtoken"), F.col("n_q")).cast("int"))
         .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("n_m").cast("int") - 1)))
         .select("label", "qb", "mb", "qtoken", "cell", "qvec", "bound"))

    def ask(qp: pd.DataFrame, mp: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qtoken": [], "token": [], "dist": []})
        if qp.empty or mp.empty:
            return none
        lead = mp["radius"].notna()
        pivots = mp[lead].sort_values("cell", kind="stable")
        mp = mp[~lead].sort_values(["cell", "token"], kind="stable")
        names = pivots["cell"].to_numpy()
        ends = mp["cell"].to_numpy()
        lo, hi = np.searchsorted(ends, names, "left"), np.searchsorted(ends, names, "right")
        x, pv, mv = NB._matrix(qp["qvec"]), NB._matrix(pivots["vec"]), NB._matrix(mp["vec"]) if len(mp) else None
        bound, own, radius = qp["bound"].to_numpy(), qp["cell"].to_numpy(), pivots["radius"].to_numpy()
        go = np.zeros((len(x), len(pv)), dtype=bool)
        for tile in NB._tiles(len(x), len(pv)):
            go[tile] = _open_cells(x[tile], pv, radius, bound[tile], slack) & (own[tile][:, None] != names[None, :])
        limit = qp.drop_duplicates("qtoken").set_index("qtoken")["bound"] + slack  # one bound a token

        def best(found: list[pd.DataFrame]) -> pd.DataFrame:
            out = pd.concat(found, ignore_index=True).sort_values(["qtoken", "dist", "token"], kind="stable")
            return out.groupby("qtoken", sort=False).head(k)

        found = [none]
        for c in range(len(pv)):
            at = np.flatnonzero(go[:, c])
            if len(at) and hi[c] > lo[c]:
                near = NB._nearest_members(qp["qtoken"].iloc[at], x[at], mp["token"].iloc[lo[c]:hi[c]], mv[lo[c]:hi[c]], k, decimals)
                found.append(near[near["dist"].to_numpy() <= limit.reindex(near["qtoken"]).to_numpy()])
                if sum(map(len, found)) > HELD_ROWS:
                    found = [best(found)]
        return best(found).astype({"qtoken": object, "token": object})

    return q.groupBy("label", "qb", "mb").cogroup(held.groupBy("label", "qb", "mb")).applyInPandas(ask, NB._CAND)
