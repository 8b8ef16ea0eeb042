"""N-gram Jaccard join by MinHash banding (operator 6).

A document is the set of its runs of five words (a shorter document is one
run). Documents with equal sets are one node. Each node has ``bands x rows``
minhashes, both numbers chosen so that a pair of the wanted similarity shares
a band with probability ``recall``; nodes are dealt out by band hash.

1. Screen. In each bucket all minhashes of two nodes (a byte each) estimate
   their similarity; what lies ``MARGIN`` below the threshold or higher is
   linked, and a task hands on a spanning forest, not the pairs. Buckets with
   the same members are screened once; large ones are cut into blocks and the
   block pairs are tasks of their own.
2. Verify. The components of those links gather candidates. A component is cut
   into blocks by the size of its sets, every pair of blocks is a task, and
   all its pairs are compared on the full sets. Tasks hand on the number of
   links of each node and a spanning forest of the links.
3. The components of the verified links are the classes.

So no pair of a group is ever a row, copies are compared once, and a group of
many near copies is spread over tasks. Defined results: texts without words (a null text is empty)
have equal, empty sets and are one class of copies, linked to nothing else; rows that share id and text are one
document; documents without an id come last, as one in the number of copies; of documents with one id the
smaller hash of the text comes first; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import discard, map_slices, materialize, order_id
from qaspark.llm.components import components

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: How far below the threshold an estimate may lie: over four standard
#: deviations of an estimate from about 190 minhashes.
MARGIN = 0.13
#: Nodes in a block of either step, and n-grams in a block of the second.
BLOCK_NODES, BLOCK_GRAMS = 256, 400_000
#: Words remembered by a worker.
WORD_CACHE = 400_000


def choose_bands(threshold: float, recall: float, max_hashes: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with
    which ``max_hashes`` give the recall at the threshold."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest
        h = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word runs."""

    def __init__(self, n: int):
        self.n, self.words = n, _WordHashes()
        self.factors = [np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORDS(text or "")
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        m = max(1, len(h) - self.n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(min(self.n, len(h))):
            out += _mix(h[k:k + m] + np.uint64(k)) * self.factors[k]
        return np.unique(_mix(out))


class Signer:
    """Minhashes and band hashes of a set of n-gram hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.RandomState(6)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)
        self.f = np.array([pow(0x2545F4914F6CDD1D, k + 1, 1 << 64) for k in range(rows)], np.uint64)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 512):
            part = grams[at:at + 512]
            np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=least)
        least = _mix(least)
        band = _mix((least.reshape(self.bands, self.rows) * self.f).sum(axis=1, dtype=np.uint64))
        return (least >> np.uint64(56)).astype(np.uint8), band.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(ord, th, node, grams, sig, band): one row per document; ``node`` is a
    128-bit digest of its set, null for a text without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest
        shingle, sign = Shingler(n), Signer(bands, rows)
        for b in batches:
            out = []
            for t in b["t"]:
                g = shingle(t)
                if len(g):
                    sig, band = sign(g)
                    out.append((xxh3_128_digest(g.tobytes()), len(g), sig.tobytes(), band))
                else:
                    out.append((None, 0, None, None))
            yield pd.concat([b[["ord", "th"]].reset_index(drop=True),
                             pd.DataFrame(out, columns=["node", "grams", "sig", "band"])], axis=1)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(order_id(id_col).alias("ord"), F.xxhash64(text).alias("th"), text.alias("t"))
    return map_slices(texts, run, "ord long, th long, node binary, grams int, sig binary, band array<long>")


class _Forest:
    """Spanning forest of the links found in a task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[a] = b
                self.edges.append((i, j))


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks of a task; the same places for one block alone."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    own = pdf["own"].to_numpy()
    return np.flatnonzero(own == x), np.flatnonzero(own == y)


def screen(nodes: DataFrame, floor: float, n_hashes: int) -> DataFrame:
    """(a, b): a spanning forest of the node pairs of each bucket whose
    estimated similarity is at least ``floor``."""
    rows = nodes.select("node", F.posexplode("band").alias("k", "h"))
    mark = F.xxhash64("node")
    # As decimals, so that sums cannot overflow.
    sums = [F.sum(c.cast("decimal(20,0)")).alias(f"f{i}") for i, c in enumerate((mark, F.xxhash64(F.lit(1), "node")))]
    buckets = (rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("m"), *sums).where(F.col("m") > 1)
               .groupBy("m", "f0", "f1").agg(F.min(F.struct("k", "h")).alias("u")).select("u.k", "u.h", "m"))
    blocks = F.ceil(F.col("m") / BLOCK_NODES).cast("int")
    own = F.pmod(mark, F.col("nb")).cast("int")
    members = (rows.join(buckets, ["k", "h"]).withColumn("nb", blocks).withColumn("own", own)
               .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
               .select("k", "h", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "own", "node"))
    # A member of the block pair (x, x) comes once, of (x, y) once as well.
    sigs = nodes.select("node", "sig")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), n_hashes)
        left, right = _sides(pdf)
        forest, need = _Forest(len(pdf)), (floor - 1 / 256) / (1 - 1 / 256) * n_hashes
        for i in left.tolist():
            to = right if len(left) != len(right) or left[0] != right[0] else right[right > i]
            same = (sig[to] == sig[i]).sum(axis=1)
            forest.link((i, int(j)) for j in to[same >= need])
        node = pdf["node"].to_numpy()
        return pd.DataFrame([(node[i], node[j]) for i, j in forest.edges], columns=["a", "b"])

    return (members.join(sigs, "node").groupBy("k", "h", "x", "y")
            .applyInPandas(links, "a binary, b binary"))


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left],
                        np.float32).reshape(len(left), len(right))
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    out = np.zeros((len(left), len(right)), np.float32)
    parts = np.split(at, ends[:-1])
    for lo in range(0, len(grams), 8192):
        has = np.zeros((len(sets), min(8192, len(grams) - lo)), np.float32)
        for k, p in enumerate(parts):
            a, b = np.searchsorted(p, (lo, lo + 8192))  # a set's places ascend
            has[k, p[a:b] - lo] = 1
        out += has[left] @ has[right].T
    return out


def verify(nodes: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): links of a node within a block pair (b null), and forests
    of the links (links null). ``groups``: (node, root); ``sets``: (node, bytes)."""
    sizes = groups.join(nodes.select("node", "grams"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int")
    per = materialize(sizes.groupBy("root").agg(blocks.alias("nb")), "blocks")  # so that a hot root is split
    members = (groups.join(per, "root")
               .withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
               .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
               .select("root", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "own", "node"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [np.frombuffer(s, np.uint64) for s in pdf["bytes"]]
        n = np.array([len(s) for s in got], np.float64)
        left, right = _sides(pdf)
        out = []
        if len(left) and len(right):
            both = shared_counts(got, left, right).astype(np.float64)
            near = both >= threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-9
            alone = pdf["x"].iloc[0] == pdf["y"].iloc[0]
            if alone:
                np.fill_diagonal(near, False)
            node = pdf["node"].to_numpy()
            forest = _Forest(len(pdf))
            i, j = np.nonzero(near)
            forest.link(zip(left[i].tolist(), right[j].tolist(), strict=True))
            out = [(node[a], node[b], None) for a, b in forest.edges]
            out += [(node[left[k]], None, int(c)) for k, c in enumerate(near.sum(axis=1)) if c]
            if not alone:
                out += [(node[right[k]], None, int(c)) for k, c in enumerate(near.sum(axis=0)) if c]
        return pd.DataFrame({"a": [r[0] for r in out], "b": [r[1] for r in out],
                             "links": pd.array([r[2] for r in out], "Int64")})

    return (members.join(sets, "node").groupBy("root", "x", "y")
            .applyInPandas(compare, "a binary, b binary, links long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(ord, th, class_id, class_th, rep_id, n_links, n_copies) of every document.

    ``class_id``: smallest id of its class, and ``class_th`` the hash of that text;
    ``rep_id``: smallest id with the same set; ``n_links``: different texts within
    the threshold; ``n_copies``: documents with the same set."""
    bands, per = choose_bands(threshold, recall)
    known = materialize(sketch(docs, id_col, text_col, n, bands, per), "sketch")
    # Repeated rows are one document; one row with sketch per node.
    place = materialize(known.select("ord", "th", F.coalesce("node", F.lit(b"-")).alias("node")), "place")
    nodes = materialize(known.where(F.col("node").isNotNull()).groupBy("node")
                        .agg(F.min(F.struct("ord", "th", "grams", "sig", "band")).alias("r")).select("node", "r.*"), "nodes")
    discard(known)
    near = components(screen(nodes, threshold - MARGIN, bands * per))
    groups = materialize(near, "groups")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "bytes": [shingle(t).tobytes() for t in b["t"]]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = nodes.join(groups.select("node"), "node", "left_semi").select("node", "ord", "th")
    texts = docs.select(order_id(id_col).alias("ord"), F.xxhash64(text).alias("th"), text.alias("t"))
    sets = map_slices(texts.join(wanted, ["ord", "th"]).select("node", "t"), gather,
                      "node binary, bytes binary").dropDuplicates(["node"])
    found = materialize(verify(nodes, groups, sets, threshold), "links")
    classes = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    links = found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    copies = place.groupBy("node").agg(F.min(F.struct("ord", "th")).alias("rep"), F.count_distinct("ord").alias("n_copies"))
    info = (copies.join(links, "node", "left").join(classes, "node", "left")
            .select("node", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "node").alias("root")))
    info = materialize(info, "info")
    discard(nodes, groups, found)
    firsts = materialize(info.groupBy("root").agg(F.min("rep").alias("first")), "classes")
    info = info.join(firsts, "root").drop("root")
    return place.join(info, "node").select("ord", "th", F.col("first.ord").alias("class_id"), F.col("first.th").alias("class_th"),
                                           F.col("rep.ord").alias("rep_id"), "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                         threshold: float = 0.8) -> DataFrame:
    """The first document of each class by id and hash of the text, with all columns of
    ``docs``; of its repeated rows, the one with the smallest hash of all columns."""
    found = materialize(near_duplicates(docs, id_col, text_col, n, threshold).select(
        "ord", "th", ((F.col("ord") == F.col("class_id")) & (F.col("th") == F.col("class_th"))).alias("first")), "nj-found")
    first = found.where("first").groupBy("ord", "th").agg(F.count(F.lit(1)).alias("_nj_rows"))
    first = materialize(first, "nj-first").withColumnsRenamed({"ord": "_nj_ord", "th": "_nj_th"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_nj_ord": order_id(id_col), "_nj_th": F.xxhash64(text)})
    keys = ["_nj_ord", "_nj_th"]
    once = keyed.join(first.where(F.col("_nj_rows") == 1).select(*keys), keys, "left_semi").select(*docs.columns)
    if first.where(F.col("_nj_rows") > 1).isEmpty():
        return once
    again = (keyed.join(first.where(F.col("_nj_rows") > 1).select(*keys), keys, "left_semi").groupBy(*keys)
             .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r")).select("r.*"))
    return once.unionByName(again)
