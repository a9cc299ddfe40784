"""Ranked lexical search by the Best Position Algorithm.

1. Documents are cut into shards of bounded text. A shard holds all terms of its
   documents, so a direct access never leaves it. Only terms that occur in a query get
   lists; a bit map of fixed size tells most others at once, an equi-join the rest.
2. Corpus statistics (documents, terms, document frequencies) are sums over all shards.
3. In a shard each term is an impact list: documents by falling impact. A query reads
   its lists from the top. Whatever it meets is looked up in all its other lists, and
   the places found there are marked. The best position of a list is the end of its
   run of marked places from the top; no unseen document can have more impact than
   stands there. Reading stops when the sum of the impacts at the best positions is
   strictly below the k-th score, so ties are all seen.
4. The best of all shards are merged: the top k of a union is the top k of the tops.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm.common import settle, word_hashes

K = 20
#: Bytes of text, and documents, of a shard; bytes that are taken apart at once.
SHARD_BYTES = 32_000_000
SHARD_DOCS = 50_000
PIECE_BYTES = 2_000_000
#: Queries that search a shard together.
BLOCK_QUERIES = 256
#: Bits of the map of query terms.
MAP_BITS = 1 << 22
#: Places read from each list before the bounds are looked at for the first time.
FIRST_READ = 32

# ASCII letters and digits stay (letters lowered), all other ASCII separates, bytes of other characters stay
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: runs of ASCII letters, digits and non-ASCII characters, only A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _bits(terms: np.ndarray) -> np.ndarray:
    return (word_hashes(list(terms)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, terms = pd.factorize(np.array(terms_of(text) or [b""], object))
            times = np.bincount(codes)
            bits = _bits(terms)
            if terms[0] != b"":
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mark] * len(terms), pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in terms]), pa.array(times, pa.int64()), pa.array(bits)],
                    ["mark", "term", "times", "bit"],
                )


def _bit_map(terms: DataFrame) -> np.ndarray:
    """The bits of all query terms: MAP_BITS bits whatever the number of queries."""
    word = F.shiftright("bit", 6)
    # the 64th bit of a word is its sign
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = terms.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    held = np.zeros(MAP_BITS // 64, np.int64)
    for r in rows:
        held[r.word] = r.bits
    return np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)


class _Shard:
    """Lists of one shard while it is being filled."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, docs: list[tuple[int | None, list[bytes]]], wanted: np.ndarray) -> None:
        first, base = len(self.ids), len(docs)
        self.ids += [d for d, _ in docs]
        self.lengths += [len(t) for _, t in docs]
        flat = np.empty(sum(len(t) for _, t in docs), object)
        flat[:] = [t for _, ts in docs for t in ts]
        codes, terms = pd.factorize(flat)
        use = wanted[_bits(terms)]
        owner = np.repeat(np.arange(base), [len(t) for _, t in docs])
        mine = use[codes]
        keys, times = np.unique(codes[mine].astype(np.int64) * base + owner[mine], return_counts=True)
        code, at = keys // base, keys % base + first
        cuts = np.append(np.nonzero(np.diff(code, prepend=-1))[0], len(code))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.lists.setdefault(terms[code[a]], []).append((at[a:b], times[a:b]))

    def rows(self, part: int, piece: int) -> pa.RecordBatch:
        """One row of the documents (term null), then one for each list."""
        lists = [[np.concatenate(x) for x in zip(*self.lists[t], strict=True)] for t in self.lists]
        n, cuts = len(lists), np.cumsum([0, 0, *[len(at) for at, _ in lists]])
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)] + [len(self.ids)] * n, pa.int32()), pa.array([d or 0 for d in self.ids], pa.int64()))
        known = pa.ListArray.from_arrays(pa.array([0, len(self.ids)] + [len(self.ids)] * n, pa.int32()), pa.array([d is not None for d in self.ids]))
        lengths = pa.ListArray.from_arrays(pa.array([0, len(self.ids)] + [len(self.ids)] * n, pa.int32()), pa.array(self.lengths, pa.int64()))
        at, times = ([x[i] for x in lists] for i in (0, 1))
        flat = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0), pa.int32())) for x in (at, times)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * (n + 1), pa.int64()), pa.array([piece] * (n + 1), pa.int64()),
                pa.array([None, *[t.decode("utf-8", "surrogatepass") for t in self.lists]], pa.string()),
                pa.array([len(self.ids), *[len(x) for x in at]], pa.int64()), pa.array([sum(self.lengths)] + [0] * n, pa.int64()),
                ids, known, lengths, *flat,
            ],
            ["part", "piece", "term", "n_docs", "n_terms", "ids", "known", "lengths", "at", "times"],
        )


def _index(wanted: np.ndarray, shard_bytes: int, shard_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, shard = TaskContext.get().partitionId(), 0, _Shard()
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                held.append((doc_id.as_py(), terms))
                size += sum(map(len, terms)) + len(terms)
                if size > PIECE_BYTES:
                    shard.add(held, wanted)
                    shard.held += size
                    held, size = [], 0
                if shard.held > shard_bytes or len(shard.ids) + len(held) >= shard_docs:
                    if held:
                        shard.add(held, wanted)
                    yield shard.rows(part, piece)
                    piece, shard, held, size = piece + 1, _Shard(), [], 0
        if held:
            shard.add(held, wanted)
        if shard.ids:
            yield shard.rows(part, piece)

    return run


_INDEX = "part long, piece long, term string, n_docs long, n_terms long, ids array<long>, known array<boolean>, lengths array<long>, at array<int>, times array<int>"


class ImpactList:
    """One term of a shard: documents by falling impact, and the place of each document."""

    def __init__(self, at: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((at, -impact))
        self.docs, self.values = at[order], impact[order]
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        # a long list answers by a table, a short one by binary search
        self.table = None
        if len(at) * 16 > n_docs:
            self.table = np.full(n_docs, -1, np.int64)
            self.table[at] = place
        else:
            self.sorted, self.place = at, place

    def look(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: which of ``docs`` are in the list, and their places."""
        if self.table is not None:
            place = self.table[docs]
            inside = np.nonzero(place >= 0)[0]
            return inside, place[inside]
        i = np.minimum(np.searchsorted(self.sorted, docs), len(self.sorted) - 1)
        inside = np.nonzero(self.sorted[i] == docs)[0]
        return inside, self.place[i[inside]]


def best_positions(lists: list[ImpactList], times: list[int], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the k best, their scores, and the number of places read in each list."""
    seen, score = np.zeros(n_docs, bool), np.zeros(n_docs, np.int64)
    marked = [np.zeros(len(x.docs) + 1, bool) for x in lists]
    best = [0] * len(lists)
    top = np.empty(0, np.int64)
    depth, step = 0, FIRST_READ
    longest = max((len(x.docs) for x in lists), default=0)
    while depth < longest:
        read = np.unique(np.concatenate([x.docs[depth : depth + step] for x in lists]))
        fresh = read[~seen[read]]
        seen[fresh] = True
        bound = 0
        for i, x in enumerate(lists):
            inside, place = x.look(fresh)
            score[fresh[inside]] += times[i] * x.values[place]
            marked[i][place] = True
            # the last cell is never marked, so there is always a first unmarked one
            best[i] += int(marked[i][best[i] :].argmin())
            if best[i] < len(x.docs):
                bound += times[i] * int(x.values[best[i] - 1])
        top = np.concatenate([top, score[fresh]])
        if len(top) > k:
            top = np.partition(top, len(top) - k)[-k:]
        depth += step
        step *= 2
        if len(top) == k and bound < top.min():
            break
    found = np.nonzero(seen & (score > 0))[0]
    if len(found) > k:
        least = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= least]
    return found, score[found], min(depth, longest)


def _search(n_all: int, l_all: int, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["term"].isna()].iloc[0]
        lists_of = group[group["term"].notna()]
        ids, known = np.asarray(head["ids"], np.int64), np.asarray(head["known"], bool)
        # Python integers: 25 * n * N may leave 64 bits
        m = np.array([75 + (25 * int(n) * n_all) // l_all for n in head["lengths"]], np.int64)
        asked: dict[int, tuple[list[ImpactList], list[int]]] = {}
        for at, tf, weight, marks, often in zip(lists_of["at"], lists_of["times"], lists_of["weight"], lists_of["marks"], lists_of["often"], strict=True):
            at, tf = np.asarray(at, np.int64), np.asarray(tf, np.int64)
            entry = ImpactList(at, int(weight) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at])), len(ids))
            for mark, n in zip(marks, often, strict=True):
                lists, times = asked.setdefault(int(mark), ([], []))
                lists.append(entry)
                times.append(int(n))
        out = []
        for mark, (lists, times) in asked.items():
            docs, score, _ = best_positions(lists, times, len(ids), k)
            # null ids stand last among equal scores
            order = np.lexsort((ids[docs], ~known[docs], -score))[:k]
            docs = docs[order]
            out.append(pd.DataFrame({"mark": mark, "doc_id": pd.arrays.IntegerArray(ids[docs], ~known[docs]), "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"mark": [], "doc_id": [], "score": []}).astype("int64")

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query, equal scores by doc_id.

    ``docs``: doc_id, text; ``queries``: item_id, text; other columns are ignored. A null
    or empty text has no terms: such a document is found by nothing and does not count,
    such a query finds nothing. Every row is its own document: repeated rows are all
    found, and a row without doc_id stands last among equal scores. Every query row is
    asked by itself, so rows of one item_id each have their ranks; equal query rows count
    once. An empty table of either kind gives an empty result.
    """
    asks = queries.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asks = settle(asks.withColumn("mark", F.monotonically_increasing_id()))
    terms = settle(asks.select("mark", "text").mapInArrow(_query_terms, "mark long, term string, times long, bit long"))
    wanted = _bit_map(terms)
    index = settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index(wanted, shard_bytes, shard_docs), _INDEX))
    whole = index.filter("term is null").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, l = int(whole.n or 0), int(whole.l or 0)

    blocks = max(1, math.ceil(asks.count() / block_queries))
    df = index.filter("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    asked = (
        terms.join(df.select("term", weight.alias("weight")).filter("weight > 0"), "term")
        .withColumn("block", F.pmod(F.xxhash64("mark"), F.lit(blocks)).cast("int"))
        .groupBy("term", "weight", "block")
        # at most the queries of a block
        .agg(F.collect_list(F.struct("mark", "times")).alias("by"))
        .select("term", "weight", "block", F.col("by.mark").alias("marks"), F.col("by.times").alias("often"))
    )
    none = {"weight": F.lit(None).cast("long"), "marks": F.lit(None).cast("array<long>"), "often": F.lit(None).cast("array<long>")}
    heads = index.filter("term is null").withColumns(none).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = ["part", "piece", "block", "term", "weight", "ids", "known", "lengths", "at", "times", "marks", "often"]
    lists = index.filter("term is not null").join(asked, "term").select(*columns)
    found = lists.unionByName(heads.select(*columns)).groupBy("part", "piece", "block").applyInPandas(_search(n, l, k), "mark long, doc_id long, score long")
    best = W.partitionBy("mark").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.join(asks.select("mark", "item_id"), "mark").select("item_id", "rank", "doc_id", "score")


#: The same by plain sums over all documents.
ORACLE = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM raw WHERE len(terms) > 0),
whole AS (SELECT count(*)::HUGEINT AS n_all, sum(n)::HUGEINT AS l_all FROM sized),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
items AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY q, item_id, term),
scored AS (
  SELECT q, item_id, r, doc_id, sum(times * (floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_all) // l_all))))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sized USING (r) CROSS JOIN whole
  GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
