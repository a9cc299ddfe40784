"""Immutable snapshots: counts, hashes, chain, no-op detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Prefix lengths (hex digits) of the tree hash: sixteen million leaves, then
# four thousand nodes, then the root. A leaf stays small at any table size,
# because unique keys spread evenly over hash prefixes.
TREE_LEVELS = (6, 3)


def object_line() -> F.Column:
    return F.concat(F.col("object_type"), F.lit(":"), F.col("object_id"), F.lit("@"), F.col("content_hash"))


def _join_sorted(values: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(values)), "\n"), 256)


def tree_hash(rows: DataFrame, by: list[str], key: F.Column, line: F.Column) -> DataFrame:
    """Hash of all lines per group through hash-prefix levels.

    Lines are dealt out once, by the node that they belong to: leaves and nodes
    are then hashed where the lines lie, and only the hashes of nodes move on.
    The groups of ``by`` share the deal, so the copies of a line in several
    groups lie side by side and compress.
    """
    leaf, node = TREE_LEVELS
    prefix = F.substring(F.sha2(key, 256), 1, leaf)
    level = rows.select(*by, prefix.alias("_p"), line.alias("_line")).withColumn("_q", F.substring("_p", 1, node)).repartition("_q")
    level = level.groupBy(*by, "_q", "_p").agg(_join_sorted(F.col("_line")).alias("_h"))
    level = level.groupBy(*by, "_q").agg(_join_sorted(F.concat_ws(":", "_p", "_h")).alias("_h"))
    return level.groupBy(*by).agg(_join_sorted(F.concat_ws(":", "_q", "_h")).alias("content_hash"))


def _hash(objects: DataFrame, by: list[str], line: F.Column) -> DataFrame:
    key = F.concat_ws(":", "object_type", "object_id")
    return tree_hash(objects, by, key, line).withColumn("hash_mode", F.lit("tree"))


def semantic_hash(objects: DataFrame, by: list[str]) -> DataFrame:
    """Hash of which revision of which object a snapshot holds.

    The tree hash is the one definition, at any size; ``hash_mode`` beside the hash
    names it, so stored hashes tell how they came about.
    """
    return _hash(objects, by, object_line())


def object_manifest_hash(objects: DataFrame, by: list[str]) -> DataFrame:
    """Hash over the full ordered revisions, payloads included."""
    fields = ["content_hash", "object_id", "object_type", "payload", "revision_id", "valid_from", "valid_to"]
    line = F.concat(
        F.col("object_type"),
        F.lit(":"),
        F.col("object_id"),
        F.lit(" "),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}),
    )
    return _hash(objects, by, line).withColumnRenamed("content_hash", "object_manifest_hash")


def _superseded() -> F.Column:
    return (F.col("object_type") == "claim") & (F.get_json_object("payload", "$.superseded") == "true")


def snapshot_counts(objects: DataFrame, by: list[str]) -> DataFrame:
    """All counts of a snapshot manifest in one aggregation."""
    kind = F.col("object_type")
    status = F.get_json_object("payload", "$.status")
    open_con = (kind == "contradiction") & (status == "CONTRADICTED")
    return objects.groupBy(*by).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(kind == "entity").alias("entities"),
        F.count_if(kind == "relationship").alias("relationships"),
        F.count_if(kind == "source").alias("sources"),
        F.count_if(kind == "claim").alias("claims"),
        F.count_if((kind == "claim") & ~_superseded()).alias("claims_live"),
        F.count_if(_superseded()).alias("claims_superseded"),
        F.count_if(open_con).alias("contradictions_open"),
        F.count_if((kind == "contradiction") & ~F.coalesce(status == "CONTRADICTED", F.lit(False))).alias(
            "contradictions_resolved"
        ),
        F.count_if(kind == "open_question").alias("gaps"),
    )


def counts_by_type(objects: DataFrame, by: list[str]) -> DataFrame:
    return objects.groupBy(*by, "object_type").agg(F.count(F.lit(1)).alias("n"))


def build_snapshot(objects: DataFrame) -> DataFrame:
    """One manifest row per snapshot: counts, hashes and the chain link.

    ``objects`` needs snapshot_id, snapshot_sequence and evidence_cutoff.
    """
    by = ["snapshot_id", "snapshot_sequence", "evidence_cutoff"]
    counts = snapshot_counts(objects, by)
    hashes = semantic_hash(objects, ["snapshot_id"])
    manifest = object_manifest_hash(objects, ["snapshot_id"]).drop("hash_mode")
    rows = counts.join(hashes, "snapshot_id").join(manifest, "snapshot_id")
    # one row per snapshot: the ordered window below is over a small dimension
    chain = W.orderBy("snapshot_sequence")
    return rows.withColumn("previous_snapshot_id", F.lag("snapshot_id").over(chain)).withColumn(
        "generated_at", F.col("evidence_cutoff")
    )


def adjacent_pairs(snapshots: DataFrame) -> DataFrame:
    """(previous, current) snapshot pairs in sequence order."""
    chain = W.orderBy("snapshot_sequence")
    paired = snapshots.select(
        F.lag("snapshot_sequence").over(chain).alias("from_seq"),
        F.col("snapshot_sequence").alias("to_seq"),
        F.lag("snapshot_id").over(chain).alias("from_snapshot_id"),
        F.col("snapshot_id").alias("to_snapshot_id"),
        F.lag("evidence_cutoff").over(chain).alias("from_cutoff"),
        F.col("evidence_cutoff").alias("to_cutoff"),
    )
    return paired.filter("from_snapshot_id IS NOT NULL")


def chain_findings(snapshots: DataFrame) -> DataFrame:
    """Sequence gaps and broken previous links."""
    chain = W.orderBy("snapshot_sequence")
    rows = snapshots.select(
        "snapshot_id",
        "snapshot_sequence",
        "previous_snapshot_id",
        F.row_number().over(chain).alias("expected"),
        F.lag("snapshot_id").over(chain).alias("before"),
    )
    gap = F.when(F.col("snapshot_sequence") != F.col("expected"), F.lit("SEQUENCE_GAP"))
    link = F.when(~F.col("previous_snapshot_id").eqNullSafe(F.col("before")), F.lit("BROKEN_LINK"))
    return rows.select("snapshot_id", F.explode(F.array_compact(F.array(gap, link))).alias("rule"))


def ensure_snapshot(current: DataFrame, latest: DataFrame, cutoff: str) -> DataFrame:
    """Decide whether the current objects need a new snapshot.

    ``latest`` is the manifest row of the newest snapshot. The result says
    ``no-op`` when the semantic hashes agree, else it carries the next sequence.
    """
    now = semantic_hash(current, []).select(F.col("content_hash").alias("current_hash"), "hash_mode")
    last = latest.select("snapshot_id", "snapshot_sequence", "content_hash", "hash_mode")
    joined = now.join(last, "hash_mode", "left")
    same = F.coalesce(F.col("content_hash") == F.col("current_hash"), F.lit(False))
    return joined.select(
        F.when(same, "no-op").otherwise("append").alias("action"),
        F.when(same, F.col("snapshot_sequence"))
        .otherwise(F.coalesce(F.col("snapshot_sequence"), F.lit(0)) + 1)
        .alias("snapshot_sequence"),
        F.when(~same, F.col("snapshot_id")).alias("previous_snapshot_id"),
        F.col("current_hash").alias("content_hash"),
        "hash_mode",
        F.lit(cutoff).alias("generated_at"),
    )


def layer_agreement(layers: DataFrame) -> DataFrame:
    """Layers (canonical, generated, built, deployed) that must carry one hash."""
    return layers.groupBy("snapshot_id").agg(
        F.countDistinct("layer").alias("layers"),
        F.countDistinct("content_hash").alias("hashes"),
        F.when((F.countDistinct("content_hash") == 1) & (F.count_if(F.col("content_hash").isNull()) == 0), "proven")
        .otherwise("not proven")
        .alias("state"),
    )


def sort_objects(objects: DataFrame) -> DataFrame:
    return objects.orderBy("object_type", "object_id")
