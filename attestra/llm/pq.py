"""Embedding near-duplicates through a product-quantised inverted index.

Unit vectors are assigned to the nearest of ``cells`` coarse centroids; what is left
(the residual) is coded by one of 64 codewords in each subspace. Cosine >= 0.98 is a
distance of at most ``r`` = sqrt(2 - 2 * 0.98) between unit vectors, which makes both
filters exact:

* probes: the query's cell c and another cell d are divided by a hyperplane; a row of d
  within r of the query needs (|q-d|^2 - |q-c|^2) / (2 |c-d|) <= r. All cells that meet
  it are probed, so none that could hold a partner is left out;
* asymmetric table distance: the distance from a query to a row's code is off by at most
  the row's coding error, which is stored with it.

What passes is compared by cosine in double precision. The codebooks come from a bounded
sample (``SAMPLE`` rows in hash order); their quality only decides the work, not the
result. Every row is indexed. Lists and queries are dealt in blocks of bounded size;
a block returns counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import local_roots, settle
from attestra.llm.vectors import as_doubles, bucket, matrix, usable
from attestra.operators.graph import connected_components

COSINE = 0.98
SAMPLE = 8_192
SUBSPACES = 8
CODEWORDS = 64
#: Rows of a list block, and of a block of queries.
BLOCK_ROWS = 2_048


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Lloyd's centroids from distinct starting points; at most ``k``, one at least."""
    start = np.unique(points, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = distances(points, start).argmin(1)
        count = np.bincount(near, minlength=len(start))
        total = np.zeros_like(start)
        np.add.at(total, near, points)
        start = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], start)
    return start


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


class Codebook:
    """Coarse centroids and residual codewords for vectors of one length."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.width = sample.shape[1]
        self.coarse = kmeans(sample, cells)
        self.parts = np.array_split(np.arange(self.width), min(SUBSPACES, self.width))
        rest = sample - self.coarse[distances(sample, self.coarse).argmin(1)]
        self.words = [kmeans(rest[:, p], CODEWORDS) for p in self.parts]
        self.apart = np.sqrt(distances(self.coarse, self.coarse))

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and coding error of each row."""
        cell = distances(units, self.coarse).argmin(1)
        rest = units - self.coarse[cell]
        codes = np.stack([distances(rest[:, p], w).argmin(1) for p, w in zip(self.parts, self.words, strict=True)], 1)
        coded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], 1)
        return cell, codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def probes(self, units: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """Rows x cells: may the cell hold a vector within the radius? Own and later cells only."""
        d = distances(units, self.coarse)
        reach = d - d[np.arange(len(units)), cell][:, None] <= 2 * self.apart[cell] * radius + 1e-9
        return reach & (np.arange(len(self.coarse))[None] >= cell[:, None])

    def table_distances(self, units: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Queries x rows: distance from each query to each row's code, by table look-up."""
        rest = units - self.coarse[cell]
        total = np.zeros((len(units), len(codes)))
        for i, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            total += distances(rest[:, p], w)[:, codes[:, i]]
        return np.sqrt(total)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow of squares
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def _index(books: dict[int, Codebook], radius: float):
    def run(parts):
        for part in parts:
            for width, rows in part.groupby("width", sort=False):
                book, units = books[int(width)], _unit(matrix(rows["vector"]))
                cell, codes, error = book.encode(units)
                reach = book.probes(units, cell, radius)
                yield pd.DataFrame(
                    {
                        "key": rows["key"].to_numpy(), "label": rows["label"].to_numpy(), "width": width, "copies": rows["copies"].to_numpy(), "vector": rows["vector"].to_numpy(),
                        "cell": cell, "codes": list(codes.astype(np.int32)), "error": error, "probes": [np.nonzero(r)[0].astype(np.int32) for r in reach],
                    }
                )

    return run


def _compare(books: dict[int, Codebook], radius: float, cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        rows, queries = group[~asks].reset_index(drop=True), group[asks].reset_index(drop=True)
        none = pd.DataFrame({"key": [], "links": [], "other": []}).astype("int64")
        if not len(rows) or not len(queries):
            return none
        book, cell = books[int(rows["width"].iloc[0])], int(rows["list"].iloc[0])
        raw_rows, raw_queries = matrix(rows["vector"]), matrix(queries["vector"])
        u, v = _unit(raw_rows), _unit(raw_queries)
        codes, error = np.array(rows["codes"].tolist()), rows["error"].to_numpy()
        near = book.table_distances(v, cell, codes) <= radius + error[None] + 1e-9
        q, r = np.nonzero(near)
        row_keys, query_keys = rows["key"].to_numpy(), queries["key"].to_numpy()
        home = queries["home"].to_numpy()
        other = row_keys[r] != query_keys[q]
        q, r = q[other], r[other]
        linked = np.zeros(len(q), bool)
        for low in range(0, len(q), 100_000):
            s = slice(low, low + 100_000)
            linked[s] = np.einsum("ij,ij->i", v[q[s]], u[r[s]]) >= cosine
        q, r = q[linked], r[linked]
        if not len(q):
            return none
        counted_q = np.bincount(q, weights=rows["copies"].to_numpy()[r], minlength=len(queries)).astype(np.int64)
        away = home[q] != cell  # both ends of a pair of one cell come as queries
        counted_r = np.bincount(r[away], weights=queries["copies"].to_numpy()[q[away]], minlength=len(rows)).astype(np.int64)
        keys = np.concatenate([query_keys, row_keys])
        ids, place = np.unique(keys, return_inverse=True)
        links = np.bincount(place, weights=np.concatenate([counted_q, counted_r]), minlength=len(ids)).astype(np.int64)
        root = local_roots(len(ids), place[q], place[len(queries) + r])
        out = pd.DataFrame({"key": ids, "links": links, "other": ids[root]})
        return out[(links > 0) | (ids != ids[root])]

    return run


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings``.

    ``embeddings``: vec_id, embedding, label; other columns are ignored. Vectors are
    compared when labels are equal and not null and lengths are equal. A vector that is
    null, empty, zero or holds null or non-finite components links with nothing, and so
    does a row without id or label; each is its own component. Equal vectors of a label
    are one class, so copies link with each other without pairs; their vec_ids count one
    by one. An empty table gives an empty result.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    base = as_doubles(embeddings, "vec_id", "embedding", "label")
    takes_part = usable("vec_id", "vector") & F.col("label").isNotNull() & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 + 0.0 is 0.0: equal vectors get equal bytes
    active = base.filter(takes_part).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    classes = active.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a class has a number of its own, because one vec_id may stand for several vectors
    classes = settle(classes.withColumns({"width": F.size("vector"), "key": F.monotonically_increasing_id()}))
    books: dict[int, Codebook] = {}
    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    for width, n in sizes.items():
        sample = classes.filter(F.col("width") == width).orderBy(F.xxhash64("least"), "least", "vector").select("vector").limit(SAMPLE)
        books[width] = Codebook(_unit(matrix(sample.toPandas()["vector"])), int(np.clip(n // (4 * BLOCK_ROWS), 1, SAMPLE // 32)))
    if not books:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind = classes.schema["label"].dataType.simpleString()
    indexed = classes.select("key", "label", "width", "copies", "vector").mapInPandas(
        _index(books, radius), f"key long, label {kind}, width int, copies long, vector array<double>, cell int, codes array<int>, error double, probes array<int>"
    )
    indexed = settle(indexed)
    place = ["label", "width", "list"]
    asking = indexed.select("key", "label", "width", "copies", "vector", F.col("cell").alias("home"), F.explode("probes").alias("list"))
    lists = indexed.groupBy("label", "width", F.col("cell").alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("list_blocks"))
    asked = asking.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("query_blocks"))
    blocks = settle(lists.join(asked, place))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = indexed.withColumnRenamed("cell", "list").join(blocks, place)
    rows = rows.withColumn("list_block", bucket(F.col("key"), 1, F.col("list_blocks"))).withColumn("query_block", every("query_blocks"))
    asking = asking.join(blocks, place).withColumn("query_block", bucket(F.col("key"), 2, F.col("query_blocks"))).withColumn("list_block", every("list_blocks"))
    shape = [*place, "list_block", "query_block", "key", "copies", "vector"]
    both = rows.select(*shape, "codes", "error", F.lit(-1).alias("home"), F.lit(False).alias("asks")).unionByName(
        asking.select(*shape, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("double").alias("error"), "home", F.lit(True).alias("asks"))
    )
    found = settle(both.groupBy(*place, "list_block", "query_block").applyInPandas(_compare(books, radius, cosine), "key long, links long, other long"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = connected_components(found.filter("key <> other").select(F.col("key").alias("source"), F.col("other").alias("target")))
    named = classes.select("label", "vector", "key", "least", "copies").join(counts, "key", "left").join(labels.select(F.col("node").alias("key"), "component"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    # ids come in at the end: a component takes the smallest one of its classes
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("smallest").alias("component"))
    members = active.select("label", "vector", "vec_id").join(named, ["label", "vector"]).select("vec_id", "n_links", "component")
    idle = base.filter(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = members.unionByName(idle)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"))


#: The same by comparing all pairs of a label.
ORACLE = """
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
active AS MATERIALIZED (SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM raw
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM active a JOIN active b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM raw UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(raw.vec_id) AS component_id FROM reach JOIN raw ON raw.r = reach.b GROUP BY reach.a)
SELECT raw.vec_id, (SELECT count(*) FROM links WHERE links.a = raw.r) AS n_links, least.component_id, least.component_id IS NOT DISTINCT FROM raw.vec_id AS kept FROM raw JOIN least USING (r)
"""
