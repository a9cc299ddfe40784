"""Helpers shared by the corpus operators: tables, shared intermediate tables, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import checkpoint_dir

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle partitions that one stage is dealt into at most; beyond it they grow in size.
MOST_PARTITIONS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Columnar and compressed, so smaller than ``checkpoint()``; later readers prune
    columns. The folder belongs to the run: whoever names it clears it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, size: int | None, each: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into a partition for every ``each`` bytes of ``size``.

    Follows the data, where the session's number of shuffle partitions does not.
    """
    return df.repartition(max(1, min(-(-(size or 0) // each), MOST_PARTITIONS)), *keys)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words, A-Z lowered. ``bytes`` splits and lowers ASCII only."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same unsigned 64-bit hash for a word in every process."""
    if not words:
        return np.empty(0, np.uint64)
    cells = np.empty(len(words), object)
    cells[:] = words
    return pd.util.hash_array(cells, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread unsigned 64-bit values over the whole range (two multiply-shift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root
