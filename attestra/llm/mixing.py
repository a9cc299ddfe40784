"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate: how often its words are read. Among all rates that
meet the token constraint of each source, entropy balancing takes the one of least
relative entropy to the corpus, word by word. Its convex dual has one multiplier per
source; Newton steps on all of them at once, as a distributed table, solve it, and the
rates are exponential tilts exp(multiplier). Rates become whole copies stratum by stratum, from
the largest document to the smallest: what one document takes too much or too little
the next ones make up, so a stratum misses its words by about half a small document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import WORD, settle
from attestra.operators.numbering import number_rows, number_within
from attestra.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Documents of one source that are rounded together, on average.
STRATUM_ROWS = 4_096
TOLERANCE = 1e-12
NEWTON_ROUNDS = 60


def source_sizes(docs: DataFrame) -> DataFrame:
    """source, source_size, documents."""
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` with target: weights by code point of the source, null last, none above ``most`` times its size.

    Whoever would get more is set to the limit and the excess goes to the others by
    weight, until none is above. Only totals come to the driver.
    """
    numbered = number_rows(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    level = cut_lineage(numbered.withColumn("weight", weight).withColumn("full", F.lit(False)).drop("place"))
    limit = F.lit(most) * F.col("source_size")
    while True:
        free = ~F.col("full")
        sums = level.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, limit)).alias("given"), F.sum(F.when(free, F.col("weight"))).alias("weight")).first()
        rest, per = share * (sums["all"] or 0) - (sums["given"] or 0.0), sums["weight"] or 0.0
        asked = F.col("weight") * F.lit(rest / per if per else 0.0)
        over = free & (asked > limit)
        if not per or level.filter(over).isEmpty():
            return level.withColumn("target", F.when(free, asked).otherwise(limit)).drop("full", "weight")
        level = cut_lineage(level.withColumn("full", F.col("full") | over))


def balance(sources: DataFrame) -> DataFrame:
    """``sources`` with rate: Newton on the dual sum(size * exp(m)) - m * target of every source at once."""
    known = (F.col("source_size") > 0) & (F.col("target") > 0)
    table = cut_lineage(sources.withColumn("multiplier", F.lit(0.0)))
    for _ in range(NEWTON_ROUNDS):
        mass = F.col("source_size") * F.exp("multiplier")
        gradient = mass - F.col("target")
        off = table.filter(known & (F.abs(gradient) > TOLERANCE * F.col("target")))
        if off.isEmpty():
            break
        # damped: a step of more than one would leave the range where the dual is nearly quadratic
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / mass))
        table = cut_lineage(table.withColumn("multiplier", F.when(known, F.col("multiplier") - step).otherwise(F.col("multiplier"))))
    return table.withColumn("rate", F.when(known, F.exp("multiplier")).otherwise(0.0)).drop("multiplier")


def _round_down_the_sizes(most: int):
    """Whole copies for one stratum: from the largest document on, each takes the number that leaves least unpaid."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place").reset_index(drop=True)
        rate = float(group["rate"].iloc[0])
        # a rate at the limit is whole but for rounding of the exponential
        rate = round(rate) if abs(rate - round(rate)) < 1e-9 else rate
        base, words = math.floor(rate), group["size"].to_numpy()
        copies, owed = np.full(len(words), min(base, most), np.int64), 0.0
        if rate > base:
            for i, w in enumerate(words):
                owed += (rate - base) * w
                if w and owed >= w / 2:
                    copies[i] += 1
                    owed -= w
        return group.assign(copies=copies)[["mark", "copies"]]

    return run


def copies(rows: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """mark, copies for ``rows`` (mark, doc_id, source, size, print) and their ``sources``.

    The rows of a source are numbered from the largest to the smallest and dealt in turn
    to strata of one size, so all strata run from large to small documents, and rows that
    agree in everything, however many, are spread over all of them.
    """
    # null keys do not join, so sources get a key that is never null
    key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("of")
    light = rows.select(key, "mark", "size", F.col("doc_id").cast("string").alias("doc_id"), "print")
    placed = number_within(light, ["of"], [F.col("size").desc(), F.col("doc_id"), F.col("print"), F.col("mark")], "place")
    rated = placed.select("of", "mark", "size", "place").join(sources.select(key, "rate", "documents"), "of")
    stratum = F.pmod(F.col("place") - 1, F.ceil(F.col("documents") / STRATUM_ROWS))
    dealt = rated.select("of", "mark", "size", "place", "rate", stratum.alias("stratum"))
    # dealt anew, or Spark would keep the join's partitions, of which a source is one
    return dealt.repartition("of", "stratum").groupBy("of", "stratum").applyInPandas(_round_down_the_sizes(int(most)), "mark long, copies long")


def words(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and row (all columns of ``docs``): one row per row.

    ``docs``: doc_id, text, source and any other columns; with ``size`` given, text is not
    needed. Size is the number of words (null text: 0). A null source is a source of its
    own and comes last. A source without words has target 0 and rate 0. Copies are given
    row by row, also to rows that agree in everything; of these it is not told which get
    more. An empty table gives an empty result. Copies follow from ids, sizes and texts
    alone, so reruns agree.
    """
    size = words(F.col("text")) if size is None else size
    read = F.xxhash64(F.col("text").cast("string")) if "text" in docs.columns else F.lit(0).cast("long")
    sized = docs.select("doc_id", "source", size.cast("long").alias("size"), read.alias("print"), F.struct(*docs.columns).alias("row"))
    # a row is known by the mark with which it is written
    sized = settle(sized.withColumn("mark", F.monotonically_increasing_id()))
    light = sized.select("mark", "doc_id", "source", "size", "print")
    sources = settle(balance(targets(source_sizes(light), weights, share, most)))
    taken = copies(light, sources, most)
    of = sources.select(F.col("source").alias("_of"), "source_size", "target", "rate")
    whole = sized.drop("print").join(taken, "mark").drop("mark")
    return whole.join(of, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix reads them."""
    taken = mix_sources(docs).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
