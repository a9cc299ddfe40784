"""Exact top-k by inner product with sorted access only (no random access).

Rows are dealt into shards of bounded size, queries into blocks. In each shard every
dimension is a list of rows sorted by component. A query reads each list from the end
that raises its score. What has been read gives a row a lower bound (unread entries
count the least of their list) and an upper bound (unread entries count the value where
reading stands). Reading stops when no row outside can still reach the k-th lower bound
and few rows are left; the scores of those are then completed. The best of all shards
are merged: the top k of a union is the top k of the parts' top k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm.common import settle
from attestra.llm.vectors import as_doubles, bucket, matrix, usable

SHARD_ROWS = 8_192
QUERY_ROWS = 256
#: Shares of the lists that are read before the bounds are looked at again.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)


class SortedLists:
    """The lists of one shard and how far they have been read."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = rows.argsort(axis=0, kind="stable")
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(rows))[:, None], axis=0)
        self.sorted = np.take_along_axis(rows, self.order, axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, float | np.ndarray]:
        """Lower and upper bounds (queries x rows) and the bound of an unseen row after ``depth`` entries."""
        n = len(self.rows)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        from_top, from_bottom = self.rank >= n - depth, self.rank < depth
        front_top, front_bottom = self.sorted[n - depth], self.sorted[depth - 1]
        last_top, last_bottom = self.sorted[0], self.sorted[-1]
        seen = up @ (self.rows * from_top).T + down @ (self.rows * from_bottom).T
        unread_top, unread_bottom = (~from_top).astype(float), (~from_bottom).astype(float)
        low = seen + (up * last_top) @ unread_top.T + (down * last_bottom) @ unread_bottom.T
        high = seen + (up * front_top) @ unread_top.T + (down * front_bottom) @ unread_bottom.T
        return low, high, up @ front_top + down @ front_bottom


def search(lists: SortedLists, queries: np.ndarray, barred: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows that may be among its k best, at most a few more than k.

    ``barred``: for each query the index of a row that it may not return, or -1.
    """
    n, left = len(lists.rows), np.arange(len(queries))
    answer: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    for share in DEPTHS:
        depth = max(1, int(np.ceil(n * share)))
        low, high, unseen = lists.bounds(queries[left], depth)
        own = barred[left]
        at = np.nonzero(own >= 0)[0]
        low[at, own[at]] = high[at, own[at]] = -np.inf
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(left), -np.inf)
        able = (high >= kth[:, None]) & (high > -np.inf)
        few = able.sum(1) <= 16 * k
        done = ((unseen < kth) & few) | (depth == n)
        for i in np.nonzero(done)[0]:
            answer[left[i]] = np.nonzero(able[i])[0]
        left = left[~done]
        if not len(left):
            break
    return answer


def _search_block(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asking = group["asks"].to_numpy()
        width = int(group["vector"].map(len).max())
        ids, marks = group["vec_id"].to_numpy(), group["mark"].to_numpy()
        row_ids, rows = ids[~asking], matrix(group["vector"][~asking], width)
        query_ids, queries = ids[asking], matrix(group["vector"][asking], width)
        out = []
        if len(row_ids) and len(query_ids):
            place = {m: i for i, m in enumerate(marks[~asking])}
            barred = np.array([place.get(m, -1) for m in marks[asking]])
            for q, near in enumerate(search(SortedLists(rows), queries, barred, k)):
                score = rows[near] @ queries[q]
                best = np.lexsort((row_ids[near], -score))[:k]
                out.append(pd.DataFrame({"mark": marks[asking][q], "query_id": query_ids[q], "vec_id": row_ids[near][best], "score": score[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"mark": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product, ties to the smaller id.

    ``vectors`` and ``queries``: mark, vec_id, vector (array of integers as doubles; sums
    must stay below 2^53). The mark tells rows apart, as several may have one id: a query
    returns any row but that of its own mark. Shorter vectors count
    as ending in zeros. Each shard meets each block of queries, so a queries table of a
    fixed share of the rows costs work in proportion to their product, as the question
    does. Nothing is broadcast.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    deal = F.array(*[F.lit(b) for b in range(blocks)]) if blocks <= 64 else F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = vectors.select("mark", "vec_id", "vector", F.lit(False).alias("asks"), bucket(F.col("mark"), 1, F.lit(shards)).alias("shard"), F.explode(deal).alias("block"))
    asks = queries.select("mark", "vec_id", "vector", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), bucket(F.col("mark"), 2, F.lit(blocks)).alias("block"))
    found = rows.unionByName(asks).groupBy("shard", "block").applyInPandas(_search_block(k), "mark long, query_id long, vec_id long, score long")
    best = W.partitionBy("mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_top_k(embeddings: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """Top k of every query row (vec_id divisible by ``every``) among all other rows.

    Components become floor(scale * x). Rows without id, and vectors that are null,
    empty or hold null or non-finite components, take no part. Several rows of one vec_id
    are rows each: all are candidates, also for each other, and each that asks has its own
    answer. Other columns are ignored; an empty table gives an empty result; with fewer
    than k other rows all are returned.
    """
    whole = as_doubles(embeddings, "vec_id", "embedding").filter(usable("vec_id", "vector"))
    whole = whole.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    whole = settle(whole.withColumn("mark", F.monotonically_increasing_id()))
    return top_k(whole, whole.filter(F.col("vec_id") % every == 0), k)


#: The same by all products.
ORACLE = """
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
