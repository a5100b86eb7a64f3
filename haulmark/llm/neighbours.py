"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Inner product is no metric, so a vector x of a shard becomes (x, sqrt(M**2 - |x|**2)) with M the longest
norm there, and a query (q, 0): then squared distance is |q|**2 + M**2 - 2 q.x, and the nearest points
are those of largest inner product. The triangle inequality bounds how near a leaf's points can be;
a leaf is skipped when ``factor`` times that bound passes the worst neighbour found so far. With
factor 1 the search is exact; a larger factor skips more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import stored

K = 20
FACTOR = 3.0
SHARD = 16_384
LEAF = 256
#: Queries that one task holds beside a shard, and that it takes through the tree at a time.
QUERIES = 8192
STEP = 512
#: Result lists of one query that are merged at a time.
MERGE = 32


@dataclass
class Tree:
    """Distinct points of a shard, leaf after leaf, and for each leaf the rings around the vantage points above it."""

    points: np.ndarray
    lifted: np.ndarray
    longest: float
    ids: list[np.ndarray]
    leaf_at: np.ndarray
    vantage: np.ndarray
    rings: list[list[tuple[int, float, float]]]


def grow_tree(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, k: int = K) -> Tree:
    """Equal vectors become one point that knows its ids in order, so ties cost nothing."""
    points, place = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, place))
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
    own = [part[: k + 1] for part in np.split(ids[order], cuts[1:])]
    norms = np.einsum("ij,ij->i", points, points)
    longest = float(norms.max())
    lifted = np.concatenate([points, np.sqrt(np.maximum(longest - norms, 0))[:, None]], axis=1)
    vantage: list[int] = []
    leaves: list[tuple[np.ndarray, list]] = []
    waiting: list[tuple[np.ndarray, list]] = [(np.arange(len(points)), [])]
    while waiting:
        at, rings = waiting.pop()
        if len(at) <= leaf:
            leaves.append((at, rings))
            continue
        # The point farthest from the centre of its part makes a vantage point whose rings are thin.
        centre = lifted[at].mean(axis=0)
        v = at[np.argmax(((lifted[at] - centre) ** 2).sum(axis=1))]
        far = np.sqrt(((lifted[at] - lifted[v]) ** 2).sum(axis=1))
        half = np.argsort(far, kind="stable")
        vantage.append(v)
        for part in (half[: len(at) // 2], half[len(at) // 2 :]):
            waiting.append((at[part], [*rings, (len(vantage) - 1, float(far[part].min()), float(far[part].max()))]))
    order = np.concatenate([at for at, _ in leaves])
    return Tree(
        points[order], lifted[order], math.sqrt(longest), [own[i] for i in order],
        np.cumsum([0, *(len(at) for at, _ in leaves)]), lifted[vantage] if vantage else np.zeros((0, lifted.shape[1])),
        [rings for _, rings in leaves],
    )


def bounds(tree: Tree, q: np.ndarray) -> np.ndarray:
    """Least distance that each query can have to each leaf (queries by leaves)."""
    out = np.zeros((len(q), len(tree.rings)))
    if len(tree.vantage):
        square = (q**2).sum(axis=1)[:, None] + (tree.vantage**2).sum(axis=1) - 2 * q @ tree.vantage.T
        far = np.sqrt(np.maximum(square, 0))
        for i, rings in enumerate(tree.rings):
            for v, lo, hi in rings:
                np.maximum(out[:, i], lo - far[:, v], out=out[:, i])
                np.maximum(out[:, i], far[:, v] - hi, out=out[:, i])
    return out


def search(tree: Tree, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and points found for each query: first its most promising leaf, then all leaves that may improve.

    Points are ordered by their exact inner product, then by their smallest id. Matrix products
    only choose which points are looked at: whatever rounding could turn over is kept.
    """
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    k = min(k + 1, len(tree.points))  # one more, as a query may find itself
    norms = np.sqrt((q**2).sum(axis=1))
    # Distances come from differences of squares, which are off by about the root of the precision.
    least = np.maximum(bounds(tree, q) - 4e-8 * np.sqrt(q.shape[1]) * (norms + tree.longest)[:, None], 0)
    slack = 1e-15 * q.shape[1] * norms * tree.longest
    first_id = np.array([i[0] for i in tree.ids])
    score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    name = np.full((len(q), k), np.iinfo(np.int64).max)

    def look(x: int, rows: np.ndarray) -> None:
        a, b = tree.leaf_at[x : x + 2]
        near = queries[rows] @ tree.points[a:b].T >= (score[rows, -1] - slack[rows])[:, None]
        rows, near = rows[near.any(axis=1)], near[near.any(axis=1)]
        if not len(rows):
            return
        i, j = np.nonzero(near)
        width = int(near.sum(axis=1).max())
        place = np.arange(len(i)) - np.concatenate([[0], np.cumsum(near.sum(axis=1))[:-1]])[i]
        new = np.full((len(rows), width), -np.inf)
        # Summed in one fixed order, so equal vectors score equal wherever they lie.
        new[i, place] = np.concatenate(
            [(tree.points[a + j[s : s + STEP * 64]] * queries[rows[i[s : s + STEP * 64]]]).sum(axis=1) for s in range(0, len(i), STEP * 64)]
        )
        points, names = np.full(new.shape, -1), np.full(new.shape, np.iinfo(np.int64).max)
        points[i, place], names[i, place] = a + j, first_id[a + j]
        all_s, all_p, all_n = (np.concatenate([o[rows], m], axis=1) for o, m in ((score, new), (found, points), (name, names)))
        best = np.lexsort((all_n, -all_s), axis=1)[:, :k]
        score[rows], found[rows], name[rows] = (np.take_along_axis(m, best, 1) for m in (all_s, all_p, all_n))

    first = least.argmin(axis=1)
    for x in np.unique(first):
        look(x, np.flatnonzero(first == x))
    square = norms**2 + tree.longest**2
    for x in np.argsort(least.mean(axis=0), kind="stable"):
        # Squared distance is ``square`` less twice the inner product.
        rows = np.flatnonzero((first != x) & ((factor * least[:, x]) ** 2 <= square - 2 * score[:, -1] + 1e-14 * q.shape[1] * square))
        if len(rows):
            look(x, rows)
    return score, found


def _search_shard(k: int, factor: float):
    def run(key, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "part", "scores", "ids"]
        if not len(shard) or not len(asked):
            return pd.DataFrame({c: [] for c in columns})
        tree = grow_tree(np.stack(shard["vector"].to_list()).astype(np.float64), shard["vec_id"].to_numpy(), k=k)
        asked = asked.sort_values("vec_id")
        q, names, out = np.stack(asked["vector"].to_list()).astype(np.float64), asked["vec_id"].tolist(), []
        for a in range(0, len(q), STEP):
            block = q[a : a + STEP]
            scores, found = search(tree, block, k, factor)
            for score, name, points in zip(scores, names[a : a + STEP], found, strict=True):
                score, points = score[points >= 0], points[points >= 0]
                pairs = [(-s, i) for s, p in zip(score.tolist(), points.tolist(), strict=True) for i in tree.ids[p].tolist() if i != name]
                pairs = sorted(pairs)[:k]
                out.append((name, int(key[0]), [-s for s, _ in pairs], [i for _, i in pairs]))
        return pd.DataFrame(out, columns=columns)

    return run


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """``vec_id, vector`` of the vectors that take part, one row for each id (the smallest of several)."""
    x = F.col("vector")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("vector"))
    return chosen.filter(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest_neighbours(
    vectors: DataFrame, every: int, column: str = "embedding", k: int = K, factor: float = FACTOR, shard: int = SHARD
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of largest inner product with each query.

    Queries are the vectors whose id is divisible by ``every``; all vectors but the query's own are
    candidates. Vectors that are null, zero, or hold a null or non-finite component take no part.
    Ties go to the smaller id; rows that share an id count once; with fewer candidates than k all
    are returned; an empty table gives no rows. If lengths differ, the commonest counts (ties: the
    longer) and other vectors take no part. Each shard of about ``shard`` vectors
    builds its own tree and takes every query in blocks; lists of a query are merged a few at
    a time. ``factor`` 1 is exact.
    """
    if factor < 1:
        raise ValueError("factor must be 1 (exact) or more")
    good = stored(usable(vectors, column))
    widths = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    good = good.filter(F.size("vector") == F.coalesce(widths.select("d").scalar(), F.lit(0)))
    asked = good.filter(F.col("vec_id") % every == 0)
    shards = max(1, -(-good.count() // shard))
    blocks = max(1, -(-asked.count() // QUERIES))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = good.select(own(shards, 1).alias("shard"), each(blocks).alias("block"), "vec_id", "vector")
    right = asked.select(each(shards).alias("shard"), own(blocks, 2).alias("block"), F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"))
    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        _search_shard(k, factor), "query_id long, part long, scores array<double>, ids array<long>"
    )
    pair = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("far"), p["ids"].alias("id")))
    best, parts = lists.select("query_id", "part", pair.alias("best")), shards
    while True:
        parts = -(-parts // MERGE)
        best = best.withColumn("part", F.col("part") % parts).groupBy("query_id", "part").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
        if parts == 1:
            break
    ranked = best.select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )
