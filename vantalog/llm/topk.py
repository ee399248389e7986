"""Exact top-k inner product search with a ball tree per shard (operator 5).

Vectors are dealt to shards by id; each shard builds a ball tree. A first pass walks every tree greedily to one leaf
per query and tells the bound of its root; the k-th best of what all shards found is a score that the answer can't
fall below. The second pass asks only shards whose root's bound reaches that shared score, searches their trees best
bound first and stops where no bound reaches it.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAF = 64
_FOUND = "query_id long, vec_id long, score decimal(38,0), bound double"
#: Components of this size and more are held at it; products and sums up to 4,096 dimensions stay within 38 digits.
_MOST = 1 << 56


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as long, a row per row that takes part.

    Rows take no part if the id is null, the vector null, or a component null or not finite. Rows of one id are
    candidates of their own. Components of 2**56 and more after scaling are held at 2**56. An empty vector has inner
    product 0 with any other; vectors of different length never meet.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(_MOST))), F.lit(float(_MOST)))).cast("long")
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, held).alias("v"))


class BallTree:
    """Balls around means, split at the median of the widest direction; leaves hold up to ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.spans, self.kids, centers, radii, least = [], [], [], [], []
        perm: list[np.ndarray] = []
        filled = 0
        self.kids.append(None)
        self.spans.append(None)
        centers.append(None), radii.append(0.0), least.append(0)
        stack = [(0, order)]
        while stack:
            node, own = stack.pop()
            part = rows[own]
            center = part.mean(axis=0) if part.size else np.zeros(rows.shape[1])
            off = part - center
            centers[node], radii[node], least[node] = center, float(np.sqrt((off * off).sum(axis=1).max())) if part.size else 0.0, ids[own].min()
            if len(own) <= leaf or radii[node] == 0.0:
                self.spans[node] = (filled, filled + len(own))
                perm.append(own)
                filled += len(own)
                continue
            far = off[np.argmax((off * off).sum(axis=1))]
            along = off @ far
            half = np.argsort(along, kind="stable")
            for piece in (half[: len(own) // 2], half[len(own) // 2 :]):
                kid = len(self.kids)
                self.kids.append(None), self.spans.append(None), centers.append(None), radii.append(0.0), least.append(0)
                self.kids[node] = (*(self.kids[node] or ()), kid)
                stack.append((kid, own[piece]))
        at = np.concatenate(perm)
        self.ids, self.rows = ids[at], rows[at]
        self.centers, self.radii, self.least = np.array(centers), np.array(radii), least

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, queries by nodes; rounding is allowed for."""
        size = np.sqrt((queries * queries).sum(axis=1))
        top = queries @ self.centers.T + size[:, None] * self.radii
        return top + 1e-9 * (np.abs(top) + size[:, None] * (self.radii + np.sqrt((self.centers**2).sum(axis=1))) + 1)

    def scores(self, query: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        part = self.rows[span[0] : span[1]]
        if self.exact:
            return (part @ query).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in part], object)

    exact = True

    def best_first(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.lexsort((ids, -scores))
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of this tree that may be among the k best of all, best first."""
        best: list[tuple[int, int]] = []  # heap of (score, -id): its first is the worst kept
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor or len(best) == k and -bound < best[0][0]:
                break
            if self.spans[node] is None:
                for kid in self.kids[node]:
                    if bounds[kid] >= floor:
                        heapq.heappush(queue, (-bounds[kid], kid))
                continue
            a, b = self.spans[node]
            if len(best) == k and self.least[node] > -best[0][1] and -bound == best[0][0]:
                continue
            got = self.scores(query, (a, b))
            lowest = max(floor, best[0][0]) if len(best) == k else floor
            at = np.flatnonzero((got >= lowest) & (self.ids[a:b] != query_id))
            if len(at) > 4 * k:  # ties at the end count by id
                at = at[self.best_first(got[at], self.ids[a:b][at])[:k]]
            for i in at.tolist():
                item = (int(got[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]

    def probe(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best of the leaf that is reached by always taking the higher bound."""
        node = 0
        while self.spans[node] is None:
            node = max(self.kids[node], key=lambda kid: bounds[kid])
        a, b = self.spans[node]
        other = np.flatnonzero(self.ids[a:b] != query_id)
        got, ids = self.scores(query, (a, b))[other], self.ids[a:b][other]
        return [(int(got[i]), int(ids[i])) for i in self.best_first(got, ids)[:k].tolist()]


def _searcher(k: int, leaf: int, final: bool):
    def of_shard(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, Decimal | None, float | None]] = []
        if rows.num_rows and asked.num_rows:
            lengths = np.array(rows.column("v").combine_chunks().value_lengths())
            q_lengths = np.array(asked.column("v").combine_chunks().value_lengths())
            for dim in np.unique(lengths).tolist():
                pick, q_pick = np.flatnonzero(lengths == dim), np.flatnonzero(q_lengths == dim)
                if not len(q_pick):
                    continue
                own, want = rows.take(pa.array(pick)), asked.take(pa.array(q_pick))
                flat = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, dim)
                data, queries = flat(own), flat(want)
                tree = BallTree(np.asarray(own.column("vec_id")), data, leaf)
                tree.exact = dim * np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) < 2.0**53
                ids = np.asarray(want.column("query_id")).tolist()
                floors = want.column("floor").to_pylist() if final else None
                for at in range(0, len(ids), 512):  # blocks of queries bound the table of bounds
                    bounds = tree.bounds(queries[at : at + 512])
                    for i, b in enumerate(bounds, at):
                        if final:
                            found = tree.search(ids[i], queries[i], b, k, -np.inf if floors[i] is None else floors[i] - abs(floors[i]) * 1e-9)
                        else:
                            found = tree.probe(ids[i], queries[i], b, k)
                            out.append((ids[i], None, None, float(b[0])))
                        out += [(ids[i], v, Decimal(s), None) for s, v in found]
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0)), ("bound", pa.float64())]
        return pa.table({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate(kinds)})

    return of_shard


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, rows_per_shard: int = 8192, leaf: int = LEAF, queries_per_block: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with every row but those of its own id; ties to the smaller id; all rows if there are fewer.

    ``rows`` and ``queries`` have vec_id and v as ``quantised`` gives them. Shards hold about ``rows_per_shard`` rows;
    the stated set of queries meets the shards in blocks of about ``queries_per_block``, for each of which a shard
    builds its tree anew, so a task holds one shard and one block. Rows of one id count each; query rows of one id
    share their ranks. Scores are summed exactly and ranked before they are held within the range of long. Empty
    tables give an empty result.
    """
    rows, asked = saved(rows, "topk-rows"), saved(queries.select(F.col("vec_id").alias("query_id"), "v"), "topk-queries")
    shards, blocks = max(1, -(-rows.count() // rows_per_shard)), max(1, -(-asked.count() // queries_per_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    run = lambda q, search, kinds: rows.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(search, kinds)
    probed = saved(run(asked, _with_shard(_searcher(k, leaf, False)), _FOUND + ", shard int"), "topk-probes")
    floors = probed.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("floor"))
    bounds = probed.where("vec_id is null").groupBy(F.col("query_id").alias("_p"), F.col("shard").alias("_s")).agg(F.max("bound").alias("bound"))
    reached = bounds.join(floors, F.col("_p") == F.col("_q"), "left").where("floor is null or bound >= floor * (1 - signum(floor) * 1e-9)").select("_p", "_s", "floor")
    again = asked.join(reached, (F.col("query_id") == F.col("_p")) & (F.col("shard") == F.col("_s"))).drop("_p", "_s")
    found = run(again, _searcher(k, leaf, True), _FOUND)
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return top.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))


def _with_shard(searcher):
    """``searcher`` with the shard's number beside each row."""

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = searcher(key, rows, asked)
        return found.append_column("shard", pa.array([key[0].as_py()] * found.num_rows, pa.int32()))

    return run
