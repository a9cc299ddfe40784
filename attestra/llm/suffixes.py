"""Passages of 50 words and more that documents share, by sparse suffix arrays.

Of all suffixes only those at minimiser positions are kept: in every window of 16
neighbouring 8-word grams the one of smallest hash. A passage of 50 words has such a
window at its start, so two documents that share it keep the suffix at the same place of
it, at most 15 words in, and those suffixes agree in their first 35 words.

1. The kept suffixes are sorted by their first 35 words (as hashes, in buckets of the
   hash range); neighbours that agree and come from different documents are candidates.
2. A candidate is extended: every 50-word window whose minimiser it is, from up to 15
   words left of it to 50 words right, is sorted and compared the same way.
3. Windows that two documents or more hold are merged into maximal spans.

Every shared window is found through the minimiser of its start, so the spans are exact
(but for 64-bit hash collisions). Only distinct hashes of a chunk of documents travel,
with the number of documents that hold them: a passage that a third of all documents
quote costs a chunk one entry, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import deal, mix, settle, word_hashes, words_of
from attestra.llm.lm import TASK_BYTES, _answer, _chunks, _planes, _totals

LEAST = 50
GRAM = 8
WINDOW = 16
PREFIX = LEAST - WINDOW + 1
#: Text for each bucket of suffix hashes.
BUCKET_BYTES = 32_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ASKED = "n int, bucket long, chunk long, keys binary, counts binary"


class Words:
    """Word hashes of one chunk, with rolling hashes of any run of words."""

    def __init__(self, docs: bytes):
        rows = pa.ipc.open_stream(docs).read_all()
        texts = [words_of(t.as_py()) for t in rows.column("text")]
        self.doc_ids = rows.column("doc_id").to_pylist()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        hashes = mix(word_hashes([w for t in texts for w in t]))
        n = len(hashes)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(_BASE)
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = np.uint64(_INVERSE)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(hashes * np.multiply.accumulate(powers)[:n], out=self.sums[1:])
        self.first = self.lengths.cumsum() - self.lengths
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def run(self, start: np.ndarray, words: int) -> np.ndarray:
        """Hash of ``words`` words from each start."""
        return mix((self.sums[start + words] - self.sums[start]) * self.inverse[start])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all 50-word windows inside documents, and the minimiser of each."""
        room = np.maximum(self.lengths - LEAST + 1, 0)
        starts = np.repeat(self.first - (room.cumsum() - room), room) + np.arange(room.sum())
        if not len(starts):
            return starts, starts
        grams = self.run(np.arange(len(self.document) - GRAM + 1), GRAM)
        views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
        at = np.empty(len(starts), np.int64)
        for low in range(0, len(starts), 100_000):
            s = starts[low : low + 100_000]
            at[low : low + 100_000] = s + views[s].argmin(1)
        return starts, at


def _per_document(keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the number of documents that hold each."""
    order = np.lexsort((document, keys))
    keys, document = keys[order], document[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
    return np.unique(keys[fresh], return_counts=True)


def _entries(n: int, chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    step = np.uint64((2**64 - 1) // buckets + 1) if buckets > 1 else None
    bucket = keys // step if step else np.zeros(len(keys), np.uint64)
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(keys)]]) if len(keys) else np.array([0])
    return [(n, int(bucket[a]), chunk, _planes(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _ask_suffixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(docs.as_py())
                kept = np.unique(words.windows()[1])
                keys, counts = _per_document(words.run(kept, PREFIX), words.document[kept]) if len(kept) else (np.empty(0, np.uint64), np.empty(0, np.int64))
                out = _entries(1, chunk, keys, counts, buckets)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "bucket", "chunk", "keys", "counts"])

    return run


def _candidates(words: Words, answers: pd.DataFrame) -> np.ndarray:
    """Starts of windows whose minimiser's suffix another document has too."""
    starts, at = words.windows()
    if not len(starts):
        return starts
    kept, place = np.unique(at, return_inverse=True)
    keys, key = np.unique(words.run(kept, PREFIX), return_inverse=True)
    return starts[(_totals(answers, 1)[key] > 1)[place]]


def _ask_windows(buckets: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for name, docs in zip(chunk["chunk"], chunk["docs"], strict=True):
            words = Words(docs)
            starts = _candidates(words, answers)
            if len(starts):
                out += _entries(2, int(name), *_per_document(words.run(starts, LEAST), words.document[starts]), buckets)
        return pd.DataFrame(out, columns=["n", "bucket", "chunk", "keys", "counts"])

    return run


def _spans(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    out = []
    for docs in chunk["docs"]:
        words = Words(docs)
        starts = _candidates(words, answers)
        if not len(starts):
            continue
        keys, key = np.unique(words.run(starts, LEAST), return_inverse=True)
        held = _totals(answers, 2)[key]
        starts, held = starts[held > 1], held[held > 1]
        if not len(starts):
            continue
        document = words.document[starts]
        opens = np.ones(len(starts), bool)
        opens[1:] = (document[1:] != document[:-1]) | (starts[1:] > starts[:-1] + LEAST)
        at = np.nonzero(opens)[0]
        last = starts[np.append(at[1:], len(starts)) - 1] + LEAST
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array([words.doc_ids[d] for d in document[at]], "Int64"), "start_word": starts[at] - words.first[document[at]], "n_words": last - starts[at],
                    "documents": np.maximum.reduceat(held, at).astype(np.int64), "doc_words": words.lengths[document[at]],
                }
            )
        )
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "start_word", "n_words", "documents", "doc_words")})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, documents, doc_words: one row per maximal span.

    A span is made of 50-word windows that at least one other row of ``docs`` holds too;
    windows that touch or overlap make one span. ``documents`` is the largest number of
    rows that hold one of its windows. ``docs``: doc_id, text; other columns are ignored.
    Words are runs of anything but ASCII white space, A-Z lowered. Null, empty and texts
    of fewer than 50 words have no spans, nor has a passage that only one document
    repeats. Repeated rows are documents like any other; a null doc_id is reported as
    null. An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.lit(False).alias("held_out"), F.col("text").cast("string"))
    chunks = settle(base.mapInArrow(_chunks, "chunk long, docs binary"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    reply = "n int, bucket long, chunk long, totals binary, types long, tokens long"

    def answered(asked: DataFrame) -> DataFrame:
        told = deal(asked, size, BUCKET_BYTES // 2, "n", "bucket").groupBy("n", "bucket").applyInPandas(_answer, reply)
        return settle(told.select("n", "bucket", "chunk", "totals"))

    def beside(told: DataFrame):
        """Each chunk with what it was told."""
        return deal(chunks, size, TASK_BYTES, "chunk").groupBy("chunk").cogroup(deal(told, size, TASK_BYTES, "chunk").groupBy("chunk"))

    first = answered(chunks.mapInArrow(_ask_suffixes(buckets), _ASKED))
    second = answered(beside(first).applyInPandas(_ask_windows(buckets), _ASKED))
    both = first.unionByName(second)
    return beside(both).applyInPandas(_spans, "doc_id long, start_word long, n_words long, documents long, doc_words long")
