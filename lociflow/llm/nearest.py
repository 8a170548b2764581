"""Approximate nearest neighbours by query-aware, collision-counting hashing.

Vectors are dealt into shards. A shard's index is PROJECTIONS single projections, each a sorted array; the lines are rows of random
rotations, which tell distances better than independent ones. A query puts a window around its own projection in each array, and virtual
rehashing widens all windows, round by round: by the factor FAST while no vector is near the threshold, then by RATIO, and when k vectors
are measured to the width that ends the search. Only what a window gains is read. A vector that has been in the share COLLISIONS
of the windows, at least, is measured exactly.

The difference of two vectors at distance d has a projection of about normal size d, so that a window of half-width Z * d holds
COLLISIONS of them. A query ends in a shard when its windows are `slack` wider than those of the k-th nearest that it has measured: a
vector that is nearer than that has met the threshold by then, but for chance. Nothing else ends it, no budget or count of candidates;
with slack = infinity all windows hold everything, and the answer is exact.

Every row is indexed. Queries are a stated set, which meets all shards in blocks: a task builds one shard's index once, for up to BLOCK
queries (0.1 % of its time if the block is full), and sends k rows a query. With N vectors and Q queries, Q * N / SHARD queries and
Q * N / BLOCK vectors are sent, besides Q * k * N / SHARD rows of results, of which k a query and task pass the limit before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .embedding_dedup import usable
from .shared import written

PROJECTIONS, COLLISIONS, Z, SLACK, FAST, RATIO, START, SEED = 128, 0.8, 1.2816, 0.07, 1.3, 1.1, 0.3, 17
#: Vectors of a shard and queries of a block, about. Their numbers depend on the tables alone, so that every cluster gives the same answer.
SHARD, BLOCK = 16384, 16384


def lines(d: int) -> np.ndarray:
    """Columns: directions of random rotations of d dimensions, as long as makes a projection's variance that of a coordinate's sum."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-PROJECTIONS // d))], axis=1)[:, :PROJECTIONS] * math.sqrt(d)


class Index:
    """Sorted projections of a shard, all in one ascending array: line i's are raised by i times `gap`."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.lines = ids, vectors, lines(vectors.shape[1])
        self.scale = float(np.abs(vectors).max()) or 1.0
        at = (vectors / self.scale @ self.lines).T
        self.spread = float(np.median(at.std(axis=1))) or 1.0
        order = np.argsort(at, axis=1, kind="stable")
        at = np.take_along_axis(at, order, axis=1)
        self.order = order.ravel()
        self.low = float(at.min())
        self.gap = 2 * (float(at.max()) - self.low) + 1
        self.raised = self.gap * np.arange(PROJECTIONS)
        self.flat = (at - self.low + self.raised[:, None]).ravel()
        self.first = len(ids) * np.arange(PROJECTIONS)

    def _find(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.clip(np.searchsorted(self.flat, np.clip(at, -self.gap / 4, 0.74 * self.gap) + self.raised, side), self.first, self.first + len(self.ids))

    def search(self, own: int, query: np.ndarray, k: int, slack: float = SLACK) -> tuple[list[tuple[float, int]], int]:
        """The k nearest found, by distance, then id, never a vector of id `own`; and how many vectors were measured."""
        n, need = len(self.ids), math.ceil(COLLISIONS * PROJECTIONS)
        at = query / self.scale @ self.lines - self.low
        low = self._find(at, "left")
        high, hits, dist, open_ = low.copy(), np.zeros(n, dtype=np.int64), np.empty(n), self.ids != own
        hits[~open_] = -PROJECTIONS
        measured = np.empty(0, dtype=np.int64)
        half = math.inf if math.isinf(slack) else START * self.spread
        while True:
            a, b = np.minimum(self._find(at - half, "left"), low), np.maximum(self._find(at + half, "right"), high)
            new = [self.order[x:y] for x, y in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()]) if x < y]
            low, high = a, b
            if new:
                hits += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((hits >= need) & open_)
            if len(fresh):
                open_[fresh] = False
                dist[fresh] = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))
                measured = np.concatenate([measured, fresh])
            enough = Z * (1 + slack) * np.partition(dist[measured], k - 1)[k - 1] / self.scale if len(measured) >= k else math.inf
            if enough <= half or (low == self.first).all() and (high == self.first + n).all():
                best = measured[np.lexsort((self.ids[measured], dist[measured]))[:k]]
                return [(float(dist[x]), int(self.ids[x])) for x in best], len(measured)
            half = enough if math.isfinite(enough) else half * (RATIO if 10 * hits.max() > 6 * need else FAST)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", slack: float = SLACK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance on the original vectors): up to k rows a query, ties to the smaller id.

    Candidates are all rows but those with the query's id. Vectors that are null, empty, zero or hold null or non-finite components and
    rows with a null id take no part; nor do vectors of another length than the query's. Rows that repeat an id are candidates each; a
    repeated query is answered once. Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    src = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    src, _ = written(src.filter(F.col("_id").isNotNull() & usable(F.col("_v"))), "search")
    n, q = src.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_q").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))
    shard, block = F.pmod(F.xxhash64("_id", "_v"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(blocks)).cast("int")
    data = src.select(shard.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "_id", "_v", F.lit(False).alias("_q"))
    asked = src.filter("_q").dropDuplicates(["_id"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"), "_id", "_v", F.lit(True).alias("_q"))

    def tile(pdf):
        rows, pdf = [], pdf.sort_values("_id", kind="stable")
        sizes = pdf["_v"].map(len)
        for d in sizes.unique():
            part = pdf[sizes == d]
            stored, queries = part[~part["_q"]], part[part["_q"]]
            if len(stored) and len(queries):
                index = Index(stored["_id"].to_numpy(), np.stack(stored["_v"].to_numpy()).astype(float))
                for own, v in zip(queries["_id"], queries["_v"]):
                    rows += [(own, x, s) for s, x in index.search(own, np.asarray(v, dtype=float), k, slack)[0]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = data.unionByName(asked).groupBy("s", "b").applyInPandas(tile, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
