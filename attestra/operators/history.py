"""Revision chains of single objects over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def revision_chain(objects: DataFrame) -> DataFrame:
    """One row per revision with the first and last snapshot that held it.

    An object's revision_id follows from its content_hash, and every row names its
    snapshot. Where a revision ends is read from the row before the next one begins, in the
    order that the rows are sorted in anyway, so no table of all revisions is hashed.
    """
    history = W.partitionBy("object_type", "object_id").orderBy("snapshot_sequence")
    whole = history.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    running = history.rowsBetween(W.unboundedPreceding, W.currentRow)
    fresh = ~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(history))
    begins = objects.select("object_type", "object_id", "snapshot_sequence", "content_hash", "revision_id",
                            fresh.cast("int").alias("_new"), (F.row_number().over(history) == 1).alias("_first"),
                            F.lag("snapshot_sequence").over(history).alias("_before"),
                            F.last("snapshot_sequence").over(whole).alias("_end")).filter("_first OR _new = 1")
    return begins.select("object_type", "object_id", F.sum("_new").over(running).cast("int").alias("revision_number"), "revision_id", "content_hash",
                         F.col("snapshot_sequence").alias("first_snapshot_sequence"),
                         F.coalesce(F.lead("_before").over(history), F.col("_end")).alias("last_snapshot_sequence"))


def object_history(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Per object: number of revisions and its change ids in order.

    An object changes at most once per snapshot pair, so the id list is no
    longer than the number of snapshots.
    """
    key = ["object_type", "object_id"]
    revisions = revision_chain(objects).groupBy(*key).agg(F.max("revision_number").alias("revisions"))
    ids = changes.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("to_seq", "change_id"))), lambda s: s["change_id"]).alias("change_ids"))
    joined = revisions.join(ids, key, "full_outer")
    return joined.select(*key, F.coalesce("revisions", F.lit(0)).alias("revisions"),
                         F.coalesce("change_ids", F.array().cast("array<string>")).alias("change_ids"),
                         F.col("revisions").isNull().alias("removed_only"))
