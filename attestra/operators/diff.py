"""Object- and field-level differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import text as X

REVISION = ["revision_id", "content_hash", "valid_from", "valid_time_precision", "payload"]


def _fields(payload: Column) -> Column:
    """Payload as a map from field to value."""
    return F.parse_json(payload).cast("map<string,variant>")


def _members(value: Column) -> Column:
    items = F.try_variant_get(F.parse_json(value), "$", "array<variant>")
    return F.transform(items, lambda v: F.to_json(v))


def array_set_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed) members; order and repetition do not count."""
    return F.array_except(after, before), F.array_except(before, after)


def diff_fields(old_payload: Column, new_payload: Column) -> Column:
    """Changed fields of two canonical payloads, empty when they mean the same.

    A missing field equals null. Arrays compare as sets, everything else by
    value.
    """
    text = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    # both maps are built once; inside a lambda they would be rebuilt per field
    both_sides = F.map_zip_with(
        _fields(old_payload),
        _fields(new_payload),
        lambda n, a, b: F.struct(n.alias("field"), text(a).alias("previous"), text(b).alias("current")),
    )
    unequal = F.sort_array(F.filter(F.map_values(both_sides), lambda p: p["previous"] != p["current"]))

    def members(p: Column) -> Column:
        both = p["previous"].startswith("[") & p["current"].startswith("[")
        before, after = F.when(both, _members(p["previous"])), F.when(both, _members(p["current"]))
        return F.struct(p.alias("p"), both.alias("both"), before.alias("before"), after.alias("after"))

    def describe(m: Column) -> Column:
        p, both = m["p"], m["both"]
        added, removed = array_set_diff(m["before"], m["after"])
        return F.struct(
            p["field"].alias("field"),
            F.when(both, "collection").otherwise("value").alias("kind"),
            F.when(~both, p["previous"]).alias("previous"),
            F.when(~both, p["current"]).alias("current"),
            F.when(both, added).alias("added"),
            F.when(both, removed).alias("removed"),
        )

    # arrays are read once, for what was added and for what was removed
    described = F.transform(F.transform(unequal, members), describe)
    moved = lambda d: (d["kind"] == "collection") & (F.size(d["added"]) == 0) & (F.size(d["removed"]) == 0)
    return F.filter(described, lambda d: ~moved(d))


FIELD_CHANGES = (
    "array<struct<field:string,kind:string,previous:string,current:string,added:array<string>,removed:array<string>>>"
)


def _with_kind(pairs: DataFrame) -> DataFrame:
    """Add change_kind and field_changes to rows of old/new revision structs.

    The field diff is produced by a generator, so that a later filter on the
    kind reads its result instead of computing it a second time.
    """
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    differs = both & (F.col("old.content_hash") != F.col("new.content_hash"))
    changes = F.when(differs, diff_fields(F.col("old.payload"), F.col("new.payload")))
    once = F.explode(F.array(F.coalesce(changes, F.array().cast(FIELD_CHANGES))))
    rows = pairs.withColumn("field_changes", once)
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.size("field_changes") > 0, "changed")
        .otherwise("unchanged")
    )
    return rows.withColumn("change_kind", kind)


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer comparison of any two object sets on (type, id)."""
    key = ["object_type", "object_id"]
    a = old.select(*key, F.struct(*REVISION).alias("old"))
    b = new.select(*key, F.struct(*REVISION).alias("new"))
    return _with_kind(a.join(b, key, "full_outer"))


def _sent(objects: DataFrame) -> DataFrame:
    """Revisions as they are dealt out: a hash or id that follows from the rest is left out, and computed again by ``_received``."""
    told = lambda name, derived: F.when(~F.col(name).eqNullSafe(derived), F.struct(name))
    return objects.select(
        F.concat("object_type", F.lit(":")).alias("_type"), "object_id", F.col("snapshot_sequence").alias("seq"), "valid_from", "valid_time_precision", "payload",
        told("content_hash", X.content_hash(F.col("payload"))).alias("_hash"),
        told("revision_id", X.revision_id(F.col("object_id"), F.col("content_hash"))).alias("_id"))


def _received(sent: DataFrame) -> DataFrame:
    hashed = F.when(F.col("_hash").isNull(), X.content_hash(F.col("payload"))).otherwise(F.col("_hash.content_hash"))
    return sent.withColumn("content_hash", hashed).drop("_hash")


def diff_chain(objects: DataFrame, pairs: DataFrame, in_order: bool = False) -> DataFrame:
    """Differences of all neighbours of the snapshot list with a single shuffle.

    ``pairs`` lists the neighbours; sequence numbers may be missing between them.
    Every object is sorted by snapshot once: its previous row gives added and
    changed, its next row gives removed. No snapshot is joined to another, and
    a group is never larger than the number of snapshots. Unchanged rows carry
    no payload, so most of the data is not copied on. The list has one row per
    snapshot and is broadcast: left to Spark, which cannot know its size before
    the first stage ends, all revisions would be dealt out by snapshot first.
    It is joined behind the shuffle, so that its columns need not be sent.

    ``in_order``: objects lie in ranges by type and id, for ``build_changes``.
    """
    key = ["_type", "object_id"]
    before = pairs.select(F.col("to_seq").alias("seq"), F.col("from_seq").alias("before_seq"))
    after = pairs.select(F.col("from_seq").alias("seq"), F.col("to_seq").alias("after_seq"))
    # one row per snapshot of the list; objects of other snapshots take no part
    listed = before.join(after, "seq", "full_outer")
    history = W.partitionBy(*key).orderBy("seq")
    sent = _sent(objects)
    dealt = _received(sent.repartitionByRange(*key) if in_order else sent.repartition(*key)).join(F.broadcast(listed), "seq")
    parts = ["_id", "content_hash", "valid_from", "valid_time_precision", "payload"]
    rows = dealt.select("*", *[F.lag(c).over(history).alias(f"prev_{c}") for c in ["seq", *parts]], F.lead("seq").over(history).alias("next_seq"))
    continues = F.col("prev_seq") == F.col("before_seq")
    same = F.coalesce(continues & (F.col("prev_content_hash") == F.col("content_hash")), F.lit(False))

    def revision(prefix: str, payload: Column) -> Column:
        own = {c: F.col(f"{prefix}{c}") for c in parts}
        named = F.when(own["_id"].isNull(), X.revision_id(F.col("object_id"), own["content_hash"])).otherwise(own["_id"]["revision_id"])
        return F.struct(named.alias("revision_id"), *[own[c].alias(c) for c in parts[1:-1]], payload.alias("payload"))

    arrives = F.col("before_seq").isNotNull()
    leaves = F.col("after_seq").isNotNull() & F.coalesce(F.col("next_seq") != F.col("after_seq"), F.lit(True))
    sides = F.when(arrives & leaves, F.array(F.lit(False), F.lit(True))).when(arrives, F.array(F.lit(False))).when(leaves, F.array(F.lit(True)))
    flat = rows.withColumns({"_same": same, "_continues": F.coalesce(continues, F.lit(False))}).withColumn("_gone", F.explode(sides))
    gone, unchanged = F.col("_gone"), F.col("_same") & ~F.col("_gone")
    slim = lambda prefix: revision(prefix, F.when(~unchanged, F.col(f"{prefix}payload")))
    steps = flat.select(
        F.expr("left(_type, length(_type) - 1)").alias("object_type"), "object_id",
        F.when(gone, F.col("after_seq")).otherwise(F.col("seq")).alias("to_seq"),
        F.when(gone, slim("")).when(F.col("_continues"), slim("prev_")).alias("old"),
        F.when(~gone, slim("")).alias("new"))
    # the pair dimension has one row per snapshot
    return _with_kind(steps.join(F.broadcast(pairs), "to_seq"))


def graph_layer_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities and relationships of two snapshots compared by hash only."""
    key = ["object_type", "object_id"]
    kept = F.col("object_type").isin("entity", "relationship")
    a = old.filter(kept).select(*key, F.col("content_hash").alias("old_hash"))
    b = new.filter(kept).select(*key, F.col("content_hash").alias("new_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").withColumn("change_kind", kind)
