"""Scoring texts with a bigram model as a weighted backoff automaton.

States are the root (no history) and one state per known word. A state has an arc for
every word that followed it in training, weighted with the smoothed probability, and a
failure arc to the root, weighted with the probability mass left for unseen words. The
root has an arc for every word. A text is read once from left to right: take the arc if
there is one, otherwise fail to the root and take its arc; add the weights. As the state
after a word is that word's, whatever was read before, the steps of all texts of a chunk
are looked up at once, by (previous word, word), and added text by text.

    root:   p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    bigram: p(w | h) = (c(h w) + MASS p(w)) / (c(h) + MASS)      failure: MASS / (c(h) + MASS)

Counts are those of the whole training part; the model is as large as the corpus, so it
is never gathered in one place. Documents are stored in chunks. A chunk sends its
distinct n-grams (as sorted 64-bit hashes, with training counts) to buckets, a bucket
adds them up and answers each chunk with the totals of what it asked for, and the chunk
builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import deal, mix, remainder, settle, word_hashes, words_of

#: Mass that a state gives to words that never followed it, in counts.
MASS = 200.0
CHUNK_BYTES = 4_000_000
#: Text for each bucket of n-gram counts.
BUCKET_BYTES = 8_000_000
#: Text for each task that scores chunks.
TASK_BYTES = 16_000_000
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_string())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, docs): compressed tables of neighbouring documents."""
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        rows = pa.table([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PACKED, strict=True)], schema=_PACKED)
        with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "docs"])

    for batch in batches:
        for doc_id, held_out, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            held.append((doc_id.as_py(), held_out.as_py(), text))
            size += len(text or "")
            if size >= CHUNK_BYTES or len(held) >= 50_000:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


@dataclass
class Tokens:
    """The token stream of one chunk: per document its words and one end."""

    doc_ids: list
    held_out: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, docs: bytes) -> Tokens:
        rows = pa.ipc.open_stream(docs).read_all()
        texts = [words_of(t.as_py()) for t in rows.column("text")]
        lengths = np.array([len(t) + 1 for t in texts])
        words = np.empty(int(lengths.sum()), np.uint64)
        ends = lengths.cumsum() - 1
        inner = np.ones(len(words), bool)
        inner[ends] = False
        words[inner] = word_hashes([w for t in texts for w in t])
        words[ends] = END
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[ends - lengths + 1] = START
        pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(words))
        return cls(rows.column("doc_id").to_pylist(), np.array(rows.column("held_out").to_pylist(), bool), lengths, mix(words), pairs)

    def distinct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams and the place of each token's gram among them."""
        return np.unique(grams, return_inverse=True)


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte planes apart, so that the empty high bytes compress away."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def _ask(buckets: int):
    step = np.uint64((2**64 - 1) // buckets + 1) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = Tokens.of(docs.as_py())
                learn = np.repeat(~tokens.held_out, tokens.lengths)
                out = []
                for order, grams in ((1, tokens.words), (2, tokens.pairs)):
                    keys, place = tokens.distinct(grams)
                    counts = np.bincount(place, weights=learn, minlength=len(keys)).astype(np.uint32)
                    bucket = keys // step if step else np.zeros(len(keys), np.uint64)
                    starts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(keys)]])
                    for a, b in zip(starts[:-1], starts[1:], strict=True):
                        out.append((order, int(bucket[a]), chunk, _planes(keys[a:b]), counts[a:b].tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["n", "bucket", "chunk", "keys", "counts"])

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of one bucket, for each chunk in the order in which it asked."""
    keys = [_keys(k) for k in group["keys"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate([np.frombuffer(c, np.uint32) for c in group["counts"]]), minlength=len(known))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    answers = [totals[p].astype(np.uint64).tobytes() for p in np.split(place, cuts)]
    # the bucket's own figures stand in its first row
    first = np.arange(len(group)) == 0
    return pd.DataFrame(
        {"n": group["n"], "bucket": group["bucket"], "chunk": group["chunk"], "totals": answers, "types": np.where(first, int((totals > 0).sum()), 0), "tokens": np.where(first, int(totals.sum()), 0)}
    )


class Automaton:
    """The arcs that the texts of one chunk can take, as lists by number of word or pair."""

    def __init__(self, unigrams: np.ndarray, words: np.ndarray, pairs: np.ndarray, histories: np.ndarray, pair_words: np.ndarray, starts: float, tokens: int, types: int, mass: float):
        root = (unigrams + 0.5) / (tokens + 0.5 * (types + 1))
        self.root = np.log10(root)
        # the last state is the start of a text
        seen = np.append(unigrams, starts)
        fail = np.log10(mass / (seen + mass))
        arc = np.log10((pairs + mass * root[pair_words]) / (seen[histories] + mass))
        self.step = np.where(pairs > 0, arc, fail[histories] + self.root[pair_words])

    def score(self, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weights of the steps through ``pairs``, added for each text; ``first``: where texts begin."""
        return np.add.reduceat(self.step[pairs], first)


def _totals(answers: pd.DataFrame, n: int) -> np.ndarray:
    rows = answers[answers["n"] == n].sort_values("bucket")
    return np.frombuffer(b"".join(rows["totals"]), np.uint64).astype(np.float64)


def _score(tokens_learned: int, types: int, starts: int, mass: float):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for docs in chunk["docs"]:
            tokens = Tokens.of(docs)
            keys, word = tokens.distinct(tokens.words)
            pair_keys, pair = tokens.distinct(tokens.pairs)
            unigrams, pairs = _totals(answers, 1), _totals(answers, 2)
            first = np.concatenate([[0], tokens.lengths.cumsum()[:-1]])
            history = np.empty_like(word)
            history[1:] = word[:-1]
            history[first] = len(keys)
            of_pair, word_of_pair = np.empty(len(pair_keys), np.int64), np.empty(len(pair_keys), np.int64)
            of_pair[pair], word_of_pair[pair] = history, word
            machine = Automaton(unigrams, keys, pairs, of_pair, word_of_pair, starts, tokens_learned, types, mass)
            base = np.add.reduceat(machine.root[word], first)
            known = np.add.reduceat((unigrams[word] > 0).astype(np.int64), first)
            out.append(
                pd.DataFrame(
                    {"doc_id": pd.array(tokens.doc_ids, "Int64"), "held_out": tokens.held_out, "n_tokens": tokens.lengths, "n_known": known, "train_tokens": tokens_learned, "base_score": base, "score": machine.score(pair, first)}
                )
            )
        return pd.concat(out) if out else pd.DataFrame()

    return run


def score_texts(docs: DataFrame, mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``docs``: doc_id, text; other columns are ignored. Documents whose crc32(doc_id as
    text) mod 5 is 1 are held out, the others are learned from (so is a null id). A-Z are
    lowered; tokens are runs of anything but ASCII white space, then one end. A null,
    empty or blank text is its end alone. ``base_score`` is the root's log10 probability,
    ``score`` the automaton's. Repeated rows are learned and scored as often as they
    occur. Without anything to learn from every word has the same probability. An empty
    table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), F.col("text").cast("string"))
    chunks = settle(base.mapInArrow(_chunks, "chunk long, docs binary"))
    size = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(~F.col("held_out"), 1)).alias("starts")).first()
    buckets = max(1, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    asked = chunks.mapInArrow(_ask(buckets), "n int, bucket long, chunk long, keys binary, counts binary")
    dealt = deal(asked, size["bytes"], BUCKET_BYTES, "n", "bucket")
    answers = settle(dealt.groupBy("n", "bucket").applyInPandas(_answer, "n int, bucket long, chunk long, totals binary, types long, tokens long"))
    sums = answers.filter("n = 1").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    run = _score(sums["tokens"] or 0, sums["types"] or 0, size["starts"] or 0, mass)
    texts, told = (deal(df, size["bytes"], TASK_BYTES, "chunk") for df in (chunks, answers.select("n", "bucket", "chunk", "totals")))
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
