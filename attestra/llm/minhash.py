"""MinHash near-duplicates: bottom-k sketches of one hash function.

1. Every document becomes the set of its 5-word shingle hashes. Documents with the
   same set are one class; from here on only classes are compared.
2. A class keeps the ``k`` smallest hashes. Two sets of similarity 0.75 share at least
   ``least`` of them (64 and 26: a shortfall lies six standard deviations off; sets of
   at most k hashes are kept whole and share at least 0.75 n, or k - n / 3 where the
   other set is larger than k). Ordered from rare to common, they then share a value
   among the first ``size - least + 1``: only these enter the inverted lists, so lines
   that many documents quote make no pairs.
3. All lists with the same smallest member, their leader, are compared together, once,
   in blocks of a bounded number of shingles: shared retained values give overlaps, the
   union sketch filters, full sets verify. A block returns a spanning forest of its
   links, never all pairs.
   A group of many blocks is first compared block by block, the leader being in all of
   them. Members that this links to the leader are one class already, so blocks are then
   set against each other only for the rest: a hot group of near copies is sent once.
4. Connected components over the links give the classes of near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import mix, settle, word_hashes, words_of
from attestra.operators.graph import connected_components

SHINGLE = 5
K = 64
LEAST = 26
#: Shingles, and classes, that one block of a comparison holds on average.
BLOCK_SHINGLES = 300_000
BLOCK_CLASSES = 1_500
_BATCH_BYTES = 4_000_000
_MEMBER = ["leader", "cid", "n_shingles", "print_a", "print_b", "block", "all_blocks"]
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than five words make one shingle."""
    words = [words_of(t) for t in texts]
    flat = word_hashes([w for ws in words for w in ws])
    windows = np.empty(0, np.uint64)
    if len(flat) >= SHINGLE:
        windows = flat[: len(flat) - SHINGLE + 1] * _WEIGHTS[0]
        for i in range(1, SHINGLE):
            windows = windows + flat[i : len(flat) - SHINGLE + 1 + i] * _WEIGHTS[i]
        windows = mix(windows)
    start = 0
    for ws in words:
        n = len(ws)
        if n >= SHINGLE:
            yield np.unique(windows[start : start + n - SHINGLE + 1])
        elif n:
            yield mix((flat[start : start + n] * _WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)
        start += n


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Slices of bounded text, so hashes of few documents are held at once."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held > _BATCH_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _print_of(values: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set, as two signed halves."""
    d = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, marks = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        counts, high, low, kept = [], [], [], []
        for part in _pieces(texts):
            for values in shingle_sets(part):
                a, b = _print_of(values)
                counts.append(len(values))
                high.append(a)
                low.append(b)
                kept.append(values[:K].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, marks, pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
            ["doc_id", "mark", "n_shingles", "print_a", "print_b", "sketch"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, print_a, print_b, sketch: one row per row of ``docs``."""
    schema = "doc_id long, mark long, n_shingles long, print_a long, print_b long, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(_sketch, schema)


def _candidates(classes: DataFrame) -> DataFrame:
    """(leader, cid): members that share a list of rare retained values, lists joined by their leader."""
    values = classes.select("cid", "kept", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a whole set and a set of m > K hashes share 3 / 7 (n + m) of which the sketch lacks at most m - K
    whole = F.least(F.ceil(F.col("kept") * 0.75), K - F.floor(F.col("kept") / 3)).cast("int")
    held = F.when(F.col("kept") < K, whole).otherwise(LEAST)
    # values of one class only come first in the order from rare to common
    reach = (F.col("kept") - held + 1) - (F.col("kept") - F.size("shared"))
    prefix = (
        values.join(common, "value")
        .groupBy("cid", "kept")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
        .filter(reach > 0)
        .select("cid", F.explode(F.slice("shared", F.lit(1), reach)).alias("entry"))
        .select("cid", F.col("entry.value").alias("value"))
    )
    prefix = settle(prefix)
    first = prefix.groupBy("value").agg(F.min(F.struct(F.xxhash64("cid").alias("order"), "cid")).alias("first"), F.count(F.lit(1)).alias("members"))
    led = prefix.join(first.filter("members > 1"), "value")
    return led.select(F.col("first.cid").alias("leader"), "cid").distinct()


def _overlaps(sketch: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Number of retained values that each of ``rows`` shares with each of ``cols``."""
    flat = np.concatenate(sketch)
    owner = np.repeat(np.arange(len(sketch)), [len(s) for s in sketch])
    _, value, seen = np.unique(flat, return_inverse=True, return_counts=True)
    held = seen[value] > 1
    owner, value = owner[held], np.unique(value[held], return_inverse=True)[1]
    total = np.zeros((len(rows), len(cols)), np.float32)
    at_row, at_col = (np.full(len(sketch), -1) for _ in range(2))
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    for low in range(0, int(value.max(initial=-1)) + 1, 4096):
        inside = (value >= low) & (value < low + 4096)
        left, right = np.zeros((len(rows), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
        o, v = owner[inside], value[inside] - low
        m = at_row[o] >= 0
        left[at_row[o[m]], v[m]] = 1
        m = at_col[o] >= 0
        right[at_col[o[m]], v[m]] = 1
        total += left @ right.T
    return total


def _union_estimate(pad: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """May the pair reach 0.75 by the sketch of its union? Six standard deviations of slack, none for whole sets."""
    both = np.sort(np.concatenate([pad[a], pad[b]], axis=1), axis=1)
    top = np.uint64(2**64 - 1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    fresh = np.ones(both.shape, bool)
    fresh[:, 1:] = ~twice
    fresh &= both != top
    order = fresh.cumsum(1)
    used = np.minimum(order[:, -1], K)
    shared = (twice & (order[:, 1:] <= K)).sum(1)
    whole = (sizes[a] <= K) & (sizes[b] <= K)
    used = np.where(whole, order[:, -1], used)
    shared = np.where(whole, twice.sum(1), shared)
    slack = np.where(whole, 1e-9, 6 * np.sqrt(0.75 * 0.25 / K))
    return shared >= (0.75 - slack) * used


def _links(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links of one block, or between two blocks of one leader: every member and its head.

    ``settled`` tells which members the links join to the leader; members of a group of
    many blocks keep their text, as these blocks may have to meet.
    """
    sets: list[np.ndarray] = []
    keep: list[int] = []
    rows = list(zip(group["text"], group["print_a"], group["print_b"], strict=True))
    i = 0
    for part in _pieces([r[0] for r in rows]):
        for values in shingle_sets(part):
            if len(values) and _print_of(values) == (rows[i][1], rows[i][2]):
                sets.append(values)
                keep.append(i)
            i += 1
    group = group.iloc[keep].reset_index(drop=True)
    none = group.iloc[:0][_MEMBER].assign(target=np.empty(0, np.int64), settled=np.empty(0, bool), text=None)
    if len(group) < 2:
        return none
    within = group["low"].iloc[0] == group["high"].iloc[0]
    left = np.arange(len(group)) if within else np.nonzero((group["block"] == group["low"]).to_numpy())[0]
    right = left if within else np.nonzero((group["block"] == group["high"]).to_numpy())[0]
    if not len(left) or not len(right):
        return none
    sizes = np.array([len(s) for s in sets])
    sketch = [s[:K] for s in sets]
    kept = np.minimum(sizes, K)
    need = np.where(sizes < K, np.ceil(kept * 0.75), LEAST)
    overlap = _overlaps(sketch, left, right)
    pad = np.full((len(sets), K), 2**64 - 1, np.uint64)
    for r, s in enumerate(sketch):
        pad[r, : len(s)] = s
    root = np.arange(len(sets))
    for x, a in enumerate(left):
        near = overlap[x] >= np.minimum(need[a], need[right])
        near &= (4 * np.minimum(sizes[a], sizes[right]) >= 3 * np.maximum(sizes[a], sizes[right])) & (root[right] != root[a])
        if within:
            near &= right > a
        b = right[near]
        if not len(b):
            continue
        b = b[_union_estimate(pad, sizes, np.full(len(b), a), b)]
        for y in b:
            if root[y] == root[a]:
                continue
            shared = np.intersect1d(sets[a], sets[y], assume_unique=True).size
            if 100 * shared >= 75 * (sizes[a] + sizes[y] - shared):
                root[root == root[y]] = root[a]
    ids = group["cid"].to_numpy()
    _, first = np.unique(root, return_index=True)
    head = dict(zip(root[first], ids[first], strict=True))
    target = np.array([head[r] for r in root])
    settled = np.isin(root, root[ids == group["leader"].iloc[0]])
    return group[_MEMBER].assign(target=target, settled=settled, text=group["text"].where(group["all_blocks"] > 1, None))


def _sizes(part: Column, name: str) -> list[Column]:
    """Number of a leader's members for which ``part`` holds, and of the blocks they fill."""
    n = F.count(F.when(part, 1))
    words = F.coalesce(F.sum(F.when(part, F.col("n_shingles"))), F.lit(0))
    return [n.alias(f"{name}_n"), F.greatest(F.ceil(words / BLOCK_SHINGLES), F.ceil(n / BLOCK_CLASSES)).cast("int").alias(f"{name}_blocks")]


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit(7)), F.col(blocks)).cast("int")


def _compared(placed: DataFrame) -> DataFrame:
    """Members, their heads, settled and text for ``placed``: members with text, low and high."""
    schema = "leader long, cid long, n_shingles long, print_a long, print_b long, block int, all_blocks int, target long, settled boolean, text string"
    return settle(placed.select(*_MEMBER, "low", "high", "text").groupBy("leader", "low", "high").applyInPandas(_links, schema))


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """rep_id, rep_mark, text: one row for each representative of ``needed``, however often its row is repeated."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64(text).alias("rep_mark"), text.alias("text"))
    wanted = needed.select("rep_id", "rep_mark").distinct()
    return rows.join(wanted, ["rep_id", "rep_mark"], "left_semi").groupBy("rep_id", "rep_mark").agg(F.first("text").alias("text"))


def near_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, target) links of similarity 0.75 or more, between numbers of classes, that connect what is connected."""
    members = settle(_candidates(classes)).join(classes.select("cid", "n_shingles", "print_a", "print_b", "rep_id", "rep_mark"), "cid")
    led = members.groupBy("leader").agg(*_sizes(F.lit(True), "all")).filter("all_n > 1")
    every = F.when(F.col("cid") == F.col("leader"), F.sequence(F.lit(0), F.col("all_blocks") - 1)).otherwise(F.array(_block("all_blocks")))
    alone = members.join(led, "leader").withColumn("block", F.explode(every)).withColumns({"low": F.col("block"), "high": F.col("block")})
    found = _compared(alone.join(_texts(docs, alone), ["rep_id", "rep_mark"]))
    links = found.select(F.col("cid").alias("source"), "target").filter("source <> target")

    # the leader stands in all blocks; its own is enough here
    large = found.filter((F.col("all_blocks") > 1) & (F.col("block") == _block("all_blocks")))
    parts = settle(large.groupBy("leader").agg(*_sizes(~F.col("settled"), "loose"), *_sizes(F.col("settled"), "settled")).filter("loose_n > 0"))
    if parts.isEmpty():
        return links
    # blocks of loose members come first and meet all blocks, settled ones meet only those
    rest = large.join(parts, "leader")
    rest = rest.withColumn("block", F.when(F.col("settled"), F.col("loose_blocks") + _block("settled_blocks")).otherwise(_block("loose_blocks")))
    met = F.when(F.col("settled"), F.col("loose_blocks")).otherwise(F.col("loose_blocks") + F.col("settled_blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    # nothing comes after this, so no text is kept
    more = _compared(rest.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "all_blocks": F.lit(1)}))
    return links.union(more.select(F.col("cid").alias("source"), "target").filter("source <> target"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``docs``: doc_id, text; other columns are ignored. Words are runs of anything but
    ASCII white space, A-Z lowered. A null, empty or blank text has no shingles and is
    linked with nothing, so it is its own component. Repeated rows fall into one
    component and share its smallest doc_id. A row without doc_id is linked with
    nothing and kept. An empty table gives an empty result.
    """
    return _labelled(docs).drop("mark", "first")


def _labelled(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the mark of each row's text, and the representative of each row's component.

    A class has a number of its own, because one doc_id may stand for several
    texts. Ids only come in at the end: a component takes the smallest one of its
    classes.
    """
    base = settle(sketches(docs))
    linked = base.filter("n_shingles > 0 and doc_id is not null")
    key = ["print_a", "print_b"]
    rep = F.min(F.struct("doc_id", "mark")).alias("rep")
    classes = linked.groupBy(*key).agg(rep, F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    classes = classes.select(*key, F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"), "n_shingles", "sketch", F.size("sketch").alias("kept"))
    # written with their numbers, so nothing computes these again
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()))
    links = settle(near_links(classes, docs))
    labels = connected_components(links).select(F.col("node").alias("cid"), "component")
    named = classes.select(*key, "cid", "rep_id", "rep_mark").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min(F.struct("rep_id", "rep_mark")).alias("first"))
    named = named.join(first, "component").select(*key, "first")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = base.select("doc_id", "mark", "n_shingles", *[F.when(own, F.col(c)).alias(c) for c in key]).join(named, key, "left")
    component = F.coalesce("first.rep_id", "doc_id")
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "first")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class: that of the smallest id and, of one id, the smallest hash of its text.

    Rows that agree in id and text stay once, whatever their other columns hold; texts
    without a word are linked with nothing, so they stay once for each id; rows without id
    all stay. An empty table gives an empty result. Columns of any name and kind stay as
    they are.
    """
    chosen = (F.col("n_shingles") == 0) | ((F.col("doc_id") == F.col("first.rep_id")) & (F.col("mark") == F.col("first.rep_mark")))
    apart = "_".join(docs.columns)
    id_of, mark_of = f"_id_{apart}", f"_mark_{apart}"
    kept = _labelled(docs).filter(F.col("doc_id").isNotNull() & chosen).select(F.col("doc_id").alias(id_of), F.col("mark").alias(mark_of)).distinct()
    doc_id = docs["doc_id"].cast("long")
    marked = docs.withColumns({id_of: doc_id, mark_of: F.xxhash64(docs["text"].cast("string"))})
    rows = marked.filter(F.col(f"`{id_of}`").isNotNull()).join(kept, [id_of, mark_of], "left_semi").dropDuplicates([id_of, mark_of])
    return rows.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter(doc_id.isNull()))
