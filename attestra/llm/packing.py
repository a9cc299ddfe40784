"""Best-fit packing of token sequences, certified by lower bounds.

Documents are tokenised where they are read and cut into pieces of at most ``capacity``
tokens. Pieces are dealt to partitions of bounded size by hash. Each partition packs its
pieces by best-fit decreasing and certifies the number of sequences with dual-feasible
functions: no packing needs fewer than the bound. As long as there are more sequences
than the bound of all pieces together asks for, partitions with gaps exchange documents:
a partition above its own bound hands over all sequences that are not full, one that
meets it those that are emptiest. What is handed over is dealt anew and packed again,
until a round saves nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm.common import settle

CAPACITY = 2048
#: Pieces that a packing partition holds on average.
PART_PIECES = 65_536
#: A partition that meets its bound hands over its emptiest sequence and those with more than this share of their room free.
FREE_SHARE = 1 / 16
#: Words whose ids a worker remembers; rarer words are looked up by the model each time.
_REMEMBERED = 400_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens(dict):
    """Lower-case Latin-1 word -> its token ids as 16-bit bytes.

    Only right for vocabularies whose tokenizer lower-cases, splits at white space and
    treats a run of letters as one unit. The model still does the merging.
    """

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(33, 256) if chr(c).isalpha()]
        self.alphabet = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # one pass lowers letters and turns the two other white-space characters into spaces
        self.plain = bytes(32 if c in (0x85, 0xA0) else ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        if text.isalpha():
            ids = [t.id for t in self.model.tokenize(text.translate(self.alphabet))]
        elif text[-1] in ".," and text[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = np.array(ids, np.uint16).tobytes()
        if len(self) < _REMEMBERED:
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or b"<|" in raw:  # other scripts, and strings that may be special tokens
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, raw.translate(self.plain).split())), np.uint16).astype(np.uint32)


@cache
def _tokens(vocabulary: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return WordTokens(Tokenizer.from_file(public_tokenizers.path(vocabulary)))


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(words.encode(text.as_py() or ""), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(vocabulary, capacity, end_id), _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the number of bins.

    Open bins are kept by what is left in them; the bits of one integer tell which
    remainders occur, so the tightest fit is its lowest bit at or above the length.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, count = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = present >> size
        if fitting:
            rest = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_rest[rest].pop()
            if not open_by_rest[rest]:
                present ^= 1 << rest
        else:
            rest, chosen = capacity, count
            count += 1
        bins[i], offsets[i] = chosen, capacity - rest
        if rest > size:
            open_by_rest[rest - size].append(chosen)
            present |= 1 << (rest - size)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(n: np.ndarray, capacity: int) -> int:
    """Most bins that any of two families of dual-feasible functions proves necessary; ``n``: items of each length."""
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for low in range(1, capacity // 2 + 1):
        # items above capacity - low fill a bin, items below low count nothing
        value = int(n[capacity - low + 1 :].sum()) * capacity + int((n * size)[low : capacity - low + 1].sum())
        best = max(best, -(-value // capacity))
    for k in range(1, 41):
        # (k + 1) x rounded down to k-ths, unless it is whole; in units of 1 / (k * capacity)
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "mark"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets, count = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        return group.assign(bin=bins, offset=offsets, filled=filled[bins], bins=count, bound=lower_bound(lengths, capacity))

    return run


def _packed(pieces: DataFrame, turn: int, capacity: int) -> DataFrame:
    parts = max(1, -(-pieces.count() // PART_PIECES))
    # dealt by the mark of the row, so rows of one id, or without one, spread like all others
    part = F.pmod(F.xxhash64("mark", F.lit(turn)), F.lit(parts))
    dealt = pieces.select("mark", "doc_id", "piece", "start", "length", "ids_crc32", F.lit(turn).cast("long").alias("turn"), part.alias("part"))
    schema = f"mark long, {_PIECE}, turn long, part long, bin long, offset long, filled long, bins long, bound long"
    return settle(dealt.groupBy("turn", "part").applyInPandas(_pack(capacity), schema))


def whole_bound(pieces: DataFrame, capacity: int) -> int:
    """Lower bound of the sequences that all pieces need, from one count for each length."""
    n = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["length"]] = r["n"]
    return bound_of(n, capacity)


def _bins(packed: DataFrame) -> int:
    """Sequences of a packing; one row for each part comes together."""
    parts = packed.groupBy("turn", "part").agg(F.first("bins").alias("bins"))
    return parts.agg(F.sum("bins")).first()[0] or 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; see the module text. No piece is longer than the capacity.

    ``rounds`` ends the exchange early, for tests.
    """
    marked = settle(pieces.withColumn("mark", F.monotonically_increasing_id()))
    least = whole_bound(marked, capacity)
    newest = _packed(marked, 0, capacity)
    settled: list[DataFrame] = []
    total, turn = _bins(newest), 0
    while total > least and (rounds is None or turn < rounds):
        turn += 1
        emptiest = newest.groupBy("turn", "part").agg(F.min("filled").alias("emptiest"))
        gaps = newest.join(emptiest, ["turn", "part"])
        open_one = (F.col("filled") == F.col("emptiest")) | (F.col("filled") < (1 - FREE_SHARE) * capacity)
        loose = (F.col("filled") < capacity) & ((F.col("bins") > F.col("bound")) | open_one)
        gaps = settle(gaps.withColumn("loose", loose).drop("emptiest"))
        moving = gaps.filter("loose").drop("loose")
        before = moving.groupBy("turn", "part").agg(F.count_distinct("bin").alias("bins"))
        before = before.agg(F.count(F.lit(1)).alias("parts"), F.sum("bins").alias("bins")).first()
        if before["parts"] < 2:
            break
        again = _packed(moving, turn, capacity)
        saved = before["bins"] - _bins(again)
        if saved <= 0:
            break
        settled.append(gaps.filter("NOT loose").drop("loose"))
        newest, total = again, total - saved
    out = newest
    for df in settled:
        out = out.unionByName(df)
    # bins of all parts in one row of numbers; some stay unused, where a bin was handed over
    parts = settle(out.groupBy("turn", "part").agg(F.max("bin").alias("last")))
    before = W.orderBy("turn", "part").rowsBetween(W.unboundedPreceding, -1)
    first = parts.select("turn", "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("first"))
    return out.join(first, ["turn", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs``: doc_id, text; other columns are ignored. A null or empty text is its end
    token alone. A null doc_id and repeated rows are packed like any other row. An empty
    table gives an empty result.
    """
    return pack(cut_pieces(docs, vocabulary, capacity), capacity)
