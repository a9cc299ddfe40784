"""References between records: bridges, dictionaries, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.extract import union_all


def bridge(df: DataFrame, key: str, refs: str, ref: str = "ref") -> DataFrame:
    """(key, ref) rows of an id array."""
    return df.select(key, F.explode(F.array_distinct(refs)).alias(ref))


def known_refs(spaces: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """All ids a derived row may cite, as distinct (space, id) rows."""
    return union_all([df.select(F.lit(space).alias("space"), F.col(col).alias("id")) for space, df, col in spaces]).distinct()


def orphan_refs(df: DataFrame, key: str, refs: str, known: DataFrame, known_id: str = "id") -> DataFrame:
    """(key, ref) rows whose reference resolves to nothing."""
    ids = known.select(F.col(known_id).alias("ref"))
    return bridge(df, key, refs).join(ids, "ref", "left_anti")


def usage(sources: DataFrame, citing: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(source_id, kind, ref_id) rows: who cites each source.

    Rows instead of one list per source, because a popular source may be cited
    by a third of all records.
    """
    bridges = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("ref_id"), F.explode(F.array_distinct(refs)).alias("source_id"))
               for kind, df, key, refs in citing]
    return union_all(bridges).join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def usage_counts(sources: DataFrame, citing: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Number of citing records per source and kind, zero included."""
    counted = usage(sources, citing).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.groupBy("source_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k, *_ in citing])
    filled = sources.select(F.col("id").alias("source_id")).join(wide, "source_id", "left")
    return filled.select("source_id", *[F.coalesce(k, F.lit(0)).alias(k) for k, *_ in citing])


def dependent_count(objects: DataFrame, refs: str = "sources") -> DataFrame:
    """How many records cite each object as a source."""
    return objects.select(F.explode(F.array_distinct(refs)).alias("object_id")).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("dependents"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r." + c).alias(c) for c in rest])
