"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Vectors are dealt to shards of bounded size and each shard builds a ball tree. A node's
upper bound for a query q is q . centre + |q| * radius. A block of queries goes down the
tree together: at every node those whose current k-th score beats the bound are done,
and the others visit the child with the higher bound first.

The first round searches each block in one shard only. The k-th scores found there go
along to all other shards in the second round, where most nodes fall below them at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelink.llm.shared import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LEAF_ROWS = 64
# Scores up to this size are exact in 64-bit floating point and leave room for a rank.
_EXACT = 1 << 42
_RANKS = 1 << 20
_NONE = np.iinfo(np.int64).min


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null
    or non-finite component."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.when(
        vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    )


class BallTree:
    """Of the rows of a matrix; rows are put in the order of the leaves."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left, right
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(0, len(vectors))
        self.rows = vectors[self.order]
        self.centre_matrix = np.array(self.centres)
        self.radius = np.array(self.radii)

    def _build(self, first: int, last: int) -> int:
        rows = self.vectors[self.order[first:last]]
        centre = rows.mean(axis=0)
        distance = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = len(self.nodes)
        self.nodes.append((first, last, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(distance.max()))
        if last - first > LEAF_ROWS and self.radii[node] > 0:
            one = rows[distance.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - one)
            middle = (last - first) // 2
            self.order[first:last] = self.order[first:last][np.argsort(along, kind="stable")]
            left = self._build(first, first + middle)
            self.nodes[node] = (first, last, left, self._build(first + middle, last))
        return node


class ShardSearch:
    """Top-k keys of queries in one shard. A key is score * 2^20 - rank, where the rank
    is the row's place by id, so larger keys are higher scores, then smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.k = ids[by_id], k
        self.tree = BallTree(vectors[by_id])
        first_ranks = [
            int(self.tree.order[first:last].min()) for first, last, _, _ in self.tree.nodes
        ]
        self.least_rank = np.array(first_ranks)

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, score: np.ndarray, at_id: np.ndarray
    ) -> np.ndarray:
        """Query x k keys, unordered; only those that beat (score, id) of the k-th known
        so far. A score of the least number says that none is known."""
        self.queries = queries
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.own = np.full(len(queries), -1)
        place = np.minimum(np.searchsorted(self.ids, query_ids), len(self.ids) - 1)
        same = self.ids[place] == query_ids
        self.own[same] = place[same]
        self.keys = np.full((len(queries), self.k), _NONE)
        rank = np.searchsorted(self.ids, at_id)
        self.floor = np.where(score == _NONE, _NONE, score * _RANKS - rank)
        self._visit(0, np.arange(len(queries)), self._bound(0, np.arange(len(queries))))
        return self.keys

    def _bound(self, node: int, chosen: np.ndarray) -> np.ndarray:
        """The largest key a row of the node can have."""
        upper = self.queries[chosen] @ self.tree.centre_matrix[node]
        reach = self.norms[chosen] * self.tree.radius[node]
        slack = 1e-9 * (np.abs(upper) + reach) + 1e-6
        return np.floor(upper + reach + slack).astype(np.int64) * _RANKS - self.least_rank[node]

    def _visit(self, node: int, chosen: np.ndarray, bound: np.ndarray) -> None:
        chosen = chosen[bound > self.floor[chosen]]
        if not len(chosen):
            return
        first, last, left, right = self.tree.nodes[node]
        if left < 0:
            for at in range(first, last, 1024):
                self._score(chosen, at, min(last, at + 1024))
            return
        of_left, of_right = self._bound(left, chosen), self._bound(right, chosen)
        near = of_left >= of_right
        self._visit(left, chosen[near], of_left[near])
        self._visit(right, chosen[~near], of_right[~near])
        self._visit(right, chosen[near], of_right[near])
        self._visit(left, chosen[~near], of_left[~near])

    def _score(self, chosen: np.ndarray, first: int, last: int) -> None:
        rank = self.tree.order[first:last]
        scores = np.rint(self.queries[chosen] @ self.tree.rows[first:last].T).astype(np.int64)
        keys = scores * _RANKS - rank
        keys[(rank[None, :] == self.own[chosen][:, None]) | (keys <= self.floor[chosen][:, None])] = _NONE
        better = np.flatnonzero((keys > _NONE).any(axis=1))
        if not len(better):
            return
        rows = chosen[better]
        every = np.concatenate((self.keys[rows], keys[better]), axis=1)
        best = np.partition(every, every.shape[1] - self.k, axis=1)[:, -self.k :]
        self.keys[rows] = best
        self.floor[rows] = np.maximum(self.floor[rows], best.min(axis=1))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers as floating point, padded with zeros."""
    out = np.zeros((len(vectors), width))
    for at, vector in enumerate(vectors):
        out[at, : len(vector)] = vector
    return out


def _plain_search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For components too large for floating point: Python's own whole numbers."""
    found = []
    vectors = [[int(x) for x in v] for v in rows["vector"]]
    for query_id, query in zip(queries["query_id"].tolist(), queries["query"]):
        q = [int(x) for x in query]
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), i)
            for i, v in zip(rows["vec_id"].tolist(), vectors)
            if i != query_id
        )[:k]
        top = 2**63 - 1
        found += [(query_id, i, max(-top, min(top, -s))) for s, i in scored]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows query_id, vec_id, score: up to k per query, none below its known k-th."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = max(max(map(len, rows["vector"])), max(map(len, queries["query"])), 1)
    of_rows, of_queries = _matrix(rows["vector"], width), _matrix(queries["query"], width)
    if np.abs(of_rows).max() * np.abs(of_queries).max() * width >= _EXACT:
        return _plain_search(queries, rows, k)
    ids = rows["vec_id"].to_numpy(np.int64)
    shard = ShardSearch(ids, of_rows, k)
    query_ids = queries["query_id"].to_numpy(np.int64)
    keys = shard.search(
        query_ids, of_queries,
        queries["kth_score"].to_numpy(np.int64), queries["kth_id"].to_numpy(np.int64),
    )
    at, column = np.nonzero(keys > _NONE)
    chosen = keys[at, column]
    score = -(-chosen // _RANKS)
    return pd.DataFrame(
        {"query_id": query_ids[at], "vec_id": shard.ids[score * _RANKS - chosen], "score": score}
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k rows with the highest integer inner product per query: query_id, rank (from
    1), vec_id, score.

    is_query  which rows are queries, a condition on `vec_id`; all rows are candidates,
              a query's own id excepted

    Ties go to the smaller id. Vectors that `whole_numbers` makes null and rows with a
    null id take no part; of rows that repeat an id the one with the least vector does.
    A shorter vector counts as filled up with zeros. Scores beyond 64 bits are cut to
    the largest one. Without candidates a query has no rows.
    """
    given = (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    every = stored(given)
    asked = every.withColumn(vec_id, F.col("vec_id")).where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query")
    )
    n_shards = max(1, -(-every.count() // shard_rows))
    n_blocks = max(1, -(-asked.count() // block_queries))
    shards = every.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    blocks = asked.withColumns(
        {
            "block": F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks)).cast("int"),
            "kth_score": F.lit(_NONE), "kth_id": F.lit(0).cast("long"),
        }
    )

    def search(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _search(queries, found, k)

    def searched(queries: DataFrame, copies: DataFrame) -> DataFrame:
        return (
            queries.groupBy("shard", "block")
            .cogroup(copies.groupBy("shard", "block"))
            .applyInPandas(search, "query_id long, vec_id long, score long")
        )

    home = F.pmod(F.col("block"), F.lit(n_shards)).cast("int")
    home_blocks = F.filter(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: F.pmod(b, F.lit(n_shards)) == F.col("shard")
    )
    first = stored(
        _best(searched(blocks.withColumn("shard", home), shards.withColumn("block", F.explode(home_blocks))), k)
        .drop("rank")
    )
    if n_shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    kth = first.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("score", "vec_id"), F.struct("score", -F.col("vec_id"))).alias("kth"),
    ).where(F.col("n") >= k)
    known = (
        blocks.drop("kth_score", "kth_id")
        .join(kth, "query_id", "left")
        .select(
            "query_id", "query", "block",
            F.coalesce("kth.score", F.lit(_NONE)).alias("kth_score"),
            F.coalesce("kth.vec_id", F.lit(0)).alias("kth_id"),
        )
    )
    others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != home)
    other_blocks = F.filter(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: F.pmod(b, F.lit(n_shards)) != F.col("shard")
    )
    rest = searched(
        known.withColumn("shard", F.explode(others)), shards.withColumn("block", F.explode(other_blocks))
    )
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
