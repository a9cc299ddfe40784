"""Change records: classify, date, relate, number and summarise differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra import rules
from attestra.operators.classify import READ, categorize_change, class_of, materiality_rank, rule_of
from attestra.operators.diff import diff_chain
from attestra.operators.extract import union_all
from attestra.operators.numbering import INDEX_BITS, number_rows, ordinal_id
from attestra.operators.succession import match_gap_resolution, match_succession
from attestra.session import cut_lineage, stored

KIND_ORDER = ["added", "removed", "changed"]
KEY = ["to_seq", "object_type", "object_id", "change_kind"]


def _ids(payload: Column, name: str) -> Column:
    return F.from_json(F.get_json_object(payload, "$." + name), "array<string>")


def technical_summary(kind: Column, object_type: Column, object_id: Column, fields: Column) -> Column:
    names = F.array_join(fields["field"], ",")
    tail = F.when(F.size(fields) > 0, F.concat(F.lit(" fields=["), names, F.lit("]"))).otherwise("")
    return F.concat(F.concat_ws(" ", kind, object_type, object_id), tail)


def requires_revalidation(change_type: Column, new_status: Column) -> Column:
    return change_type.isin(rules.REVALIDATING_CHANGES) | F.coalesce(new_status == "BLOCKED", F.lit(False))


CLASS = ["change_type", "materiality", "epistemic_impact"]
#: Record types whose ids come from their text, so that a rewording looks like a removal and an addition.
SUCCESSION_TYPES = ["open_question", "timeline_event", "financial_fact"]


#: What is read of a payload: scalars as text, and lists of ids.
PAYLOAD = ", ".join([*[f"{n} string" for n in [*READ, "retrievedAt", "text", "event", "metric", "question"]], "sources array<string>", "claims array<string>"])


def classified(diffs: DataFrame) -> DataFrame:
    """One row per difference with its class, and what succession needs to know of it."""
    # a payload is parsed once for all of its fields; it and the rule come out of
    # generators, so reading their parts never repeats the work
    changed, kind, of_type = diffs.filter("change_kind <> 'unchanged'"), F.col("change_kind"), F.col("object_type")
    parsed = F.from_json(F.coalesce("new.payload", "old.payload"), PAYLOAD)
    was = F.when(kind == "changed", F.get_json_object("old.payload", "$.status"))
    rows = changed.withColumn("_read", F.explode(F.array(F.struct(parsed.alias("any"), was.alias("was")))))
    any_of = lambda n: F.col(f"_read.any.{n}")
    new_of = lambda n: F.when(F.col("new.payload").isNotNull(), any_of(n))
    read = {n: new_of(n) for n in READ} | {"was": F.col("_read.was")}
    rows = rows.withColumn("_rule", F.explode(F.array(rule_of(kind, of_type, read, F.col("field_changes")))))
    none = F.array().cast("array<string>")
    said = [F.nullif(any_of(name), F.lit("")) for name in ("text", "event", "metric")]
    keyed = of_type.isin(SUCCESSION_TYPES)
    return rows.withColumn("class", F.explode(F.array(class_of(kind, of_type, read, F.col("_rule"))))).select(
        "from_seq", "to_seq", "from_snapshot_id", "to_snapshot_id", "from_cutoff", "to_cutoff", "change_kind", "class.*", "object_type", "object_id",
        F.col("old.revision_id").alias("old_revision_id"),
        F.col("new.revision_id").alias("new_revision_id"),
        "field_changes",
        F.col("new.valid_from").alias("effective_at"),
        F.coalesce("new.valid_time_precision", F.lit("UNKNOWN")).alias("effective_time_precision"),
        F.array_distinct(F.coalesce(new_of("sources"), none)).alias("source_ids"),
        any_of("retrievedAt").alias("own_retrieval"),
        F.coalesce(new_of("claims"), none).alias("payload_claims"),
        new_of("status").alias("_status"),
        F.when(keyed, F.coalesce(*said)).alias("_text"),
        F.when(keyed, any_of("bucket")).alias("_bucket"),
        F.when(of_type == "resolved_question", any_of("question")).alias("_question"),
    )


def resolved_gaps(rows: DataFrame) -> DataFrame:
    """(to_seq, removed_id, resolved_by): questions that left when their resolution arrived. ``rows``: ``classified``."""
    asked = rows.filter("object_type = 'open_question' AND change_kind = 'removed'").select("to_seq", F.col("object_id").alias("id"), F.col("_text").alias("text"))
    answered = rows.filter("object_type = 'resolved_question' AND change_kind = 'added'").select("to_seq", F.col("object_id").alias("id"), F.col("_question").alias("question"))
    return match_gap_resolution(asked, answered, ["to_seq"])


def successions(rows: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(to_seq, object_type, removed_id, added_id): rewordings of records whose id comes from their text.

    A question that was resolved is not looked for among the rewordings.
    """
    by = ["to_seq", "object_type"]
    shape = rows.filter(F.col("object_type").isin(SUCCESSION_TYPES)).select(*by, "change_kind", F.col("object_id").alias("id"), F.col("_text").alias("text"), F.col("_bucket").alias("bucket"))
    gone = shape.filter("change_kind = 'removed'")
    if resolved is not None:
        closed = resolved.select("to_seq", F.lit("open_question").alias("object_type"), F.col("removed_id").alias("id"))
        gone = gone.join(closed, [*by, "id"], "left_anti")
    return match_succession(gone.drop("change_kind"), shape.filter("change_kind = 'added'").drop("change_kind"), by)


def apply_succession(rows: DataFrame, matches: DataFrame | None, resolved: DataFrame | None) -> DataFrame:
    """Attach successor, predecessor and resolution, and override the class.

    ``rows``: ``classified``. ``matches``: to_seq, object_type, removed_id,
    added_id. ``resolved``: to_seq, removed_id, resolved_by.
    """
    null = F.lit(None).cast("string")
    if matches is None:
        rows = rows.withColumn("successor_object_id", null).withColumn("predecessor_object_id", null)
    else:
        out = matches.select("to_seq", "object_type", F.col("removed_id").alias("object_id"),
                             F.lit("removed").alias("change_kind"), F.col("added_id").alias("successor_object_id"))
        back = matches.select("to_seq", "object_type", F.col("added_id").alias("object_id"),
                              F.lit("added").alias("change_kind"), F.col("removed_id").alias("predecessor_object_id"))
        rows = rows.join(out, KEY, "left").join(back, KEY, "left")
    if resolved is None:
        rows = rows.withColumn("resolved_by", null)
    else:
        closed = resolved.select("to_seq", F.lit("open_question").alias("object_type"), F.col("removed_id").alias("object_id"),
                                 F.lit("removed").alias("change_kind"), "resolved_by")
        rows = rows.join(closed, KEY, "left")
    absent = (F.col("object_type") == "financial_fact") & (F.col("_bucket") == "notFound")
    settled = F.col("resolved_by").isNotNull() | (F.col("successor_object_id").isNotNull() & F.coalesce(absent, F.lit(False)))
    reworded = F.col("predecessor_object_id").isNotNull() & F.col("change_type").isin("OBJECT_ADDED", "GAP_OPENED")

    def override(gap, corrected, name):
        quiet = F.lit("INFORMATIONAL") if name == "materiality" else F.col(name)
        return F.when(settled, gap).when(F.col("successor_object_id").isNotNull(), corrected).when(reworded, quiet).otherwise(F.col(name))

    gap = ("GAP_RESOLVED", "MEDIUM", "RESOLVED")
    corrected = ("OBJECT_CORRECTED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE")
    return rows.withColumns({name: override(g, c, name) for name, g, c in zip(CLASS, gap, corrected, strict=True)})


def _finished(rows: DataFrame, *more: str) -> DataFrame:
    """Columns that follow from the final class, and ``more`` that are there already."""
    return rows.select(
        "from_seq", "to_seq", "from_snapshot_id", "to_snapshot_id", "from_cutoff", "to_cutoff", "change_kind", *CLASS, "object_type", "object_id",
        "old_revision_id", "new_revision_id", "field_changes", "effective_at", "effective_time_precision",
        F.col("to_cutoff").alias("observed_no_later_than"),
        F.col("to_cutoff").alias("published_at"),
        categorize_change(F.col("change_type"), F.col("effective_at"), F.col("from_cutoff"), F.col("to_cutoff")).alias("category"),
        "resolved_by", "successor_object_id", "predecessor_object_id",
        requires_revalidation(F.col("change_type"), F.col("_status")).alias("requires_revalidation"),
        technical_summary(F.col("change_kind"), F.col("object_type"), F.col("object_id"), F.col("field_changes")).alias("technical_summary"),
        "source_ids", "own_retrieval", "payload_claims", *more,
    )


def change_rows(diffs: DataFrame, matches: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """One row per semantic difference, unnumbered."""
    return _finished(apply_succession(classified(diffs), matches, resolved))


def observed_at(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """Oldest retrieval of the sources a change cites, in its target snapshot.

    A source change is observed at its own retrieval; unknown stays null.
    """
    cited = changes.filter("object_type <> 'source'").select(*KEY, F.explode("source_ids").alias("source_id"))
    sources = objects.filter("object_type = 'source'").select(
        F.col("snapshot_sequence").alias("to_seq"), F.col("object_id").alias("source_id"),
        F.get_json_object("payload", "$.retrievedAt").alias("retrieved"))
    oldest = cited.join(sources, ["to_seq", "source_id"]).groupBy(*KEY).agg(F.min("retrieved").alias("oldest"))
    rows = changes.join(oldest, KEY, "left")
    own = F.when(F.col("object_type") == "source", F.col("own_retrieval")).otherwise(F.col("oldest"))
    return rows.withColumn("observed_at", own).drop("oldest")


def affected_claims(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """(change key, claim_id) rows; a popular source simply gives more rows."""
    itself = changes.filter("object_type = 'claim'").select(*KEY, F.col("object_id").alias("claim_id"))
    citing = objects.filter("object_type = 'claim'").select(
        F.col("snapshot_sequence").alias("to_seq"), F.col("object_id").alias("claim_id"),
        F.explode(F.array_distinct(_ids(F.col("payload"), "sources"))).alias("object_id"))
    by_source = changes.filter("object_type = 'source'").select(*KEY).join(citing, ["to_seq", "object_id"]).select(*KEY, "claim_id")
    other = changes.filter("object_type NOT IN ('claim', 'source')").select(*KEY, F.explode("payload_claims").alias("claim_id"))
    return union_all([itself, by_source, other])


def _kind_rank() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("change_kind"))


def _change_order() -> list[Column]:
    return [F.col("to_seq"), _kind_rank(), F.concat_ws(":", "object_type", "object_id")]


def number_changes(changes: DataFrame, prefix: str = "CHG-", is_stored: bool = False) -> DataFrame:
    """Stable ids by (pair, kind, type:id). ``is_stored``: see ``number_rows``."""
    numbered = number_rows(changes, _change_order(), "_no", is_stored)
    return numbered.withColumn("change_id", ordinal_id(prefix, F.col("_no"))).drop("_no")


def placed_changes(changes: DataFrame) -> DataFrame:
    """Changes of objects that lie in ranges by type and id, stored with their place (_pos) in the order of their task."""
    return stored(changes.sortWithinPartitions(*_change_order()).withColumn("_pos", F.monotonically_increasing_id()))


def number_placed(placed: DataFrame, prefix: str = "CHG-") -> DataFrame:
    """The ids of ``number_changes`` for ``placed_changes``, without dealing the rows out again.

    Tasks hold ranges of objects, so the changes of a pair and kind are numbered
    task by task; only a count for each pair, kind and task is brought together.
    """
    by = ["to_seq", "change_kind"]
    part = F.shiftright("_pos", INDEX_BITS).alias("_part")
    runs = placed.groupBy(part, *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = W.orderBy("to_seq", _kind_rank(), "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select("_part", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # a row for each pair, kind and task: bounded by the partition count
    rows = placed.withColumn("_part", part).join(F.broadcast(offsets), ["_part", *by])
    return rows.withColumn("change_id", ordinal_id(prefix, F.col("_pos") + F.col("_offset") + 1)).drop("_part", "_pos", "_offset")


def build_changes(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Diff, classify, relate, date and number all adjacent snapshots.

    Objects are dealt out in ranges, so the classified differences are written
    once, without payloads, in an order that numbers follow from; succession and
    dates read them from there. What belongs to the pair is joined in the end.
    Dates are attached by key and add no rows, so they come after the numbers.
    Records whose ids come from their text are paired with what replaced them,
    where there are any.
    """
    pairs = cut_lineage(pairs)
    of_pair = [c for c in pairs.columns if c != "to_seq"]
    placed = placed_changes(classified(diff_chain(objects, pairs, in_order=True)).drop(*of_pair))
    if placed.filter(F.col("object_type").isin(SUCCESSION_TYPES) & (F.col("change_kind") == "removed")).isEmpty():
        numbered = apply_succession(number_placed(placed), None, None)
    else:
        rows = placed.drop("_pos")
        resolved = cut_lineage(resolved_gaps(rows))
        numbered = number_changes(apply_succession(rows, successions(rows, resolved), resolved))
    dated = observed_at(numbered, objects).join(F.broadcast(pairs), "to_seq")
    return _finished(dated, "change_id", "observed_at")


def reconciliation(diffs: DataFrame) -> DataFrame:
    """Counts per pair with both identities that must hold."""
    kind = F.col("change_kind")
    counts = diffs.groupBy("from_snapshot_id", "to_snapshot_id").agg(
        F.count_if(kind == "added").alias("objects_added"),
        F.count_if(kind == "removed").alias("objects_removed"),
        F.count_if(kind == "changed").alias("objects_changed"),
        F.count_if(kind == "unchanged").alias("objects_unchanged"),
        F.count_if(F.col("old").isNotNull()).alias("from_object_count"),
        F.count_if(F.col("new").isNotNull()).alias("to_object_count"),
    )
    kept = F.col("objects_unchanged") + F.col("objects_changed")
    return counts.withColumn("to_identity", kept + F.col("objects_added") == F.col("to_object_count")).withColumn(
        "from_identity", kept + F.col("objects_removed") == F.col("from_object_count"))


def material_only(changes: DataFrame, floor: str = "MEDIUM") -> DataFrame:
    return changes.filter(materiality_rank(F.col("materiality")) <= materiality_rank(F.lit(floor)))


def executive_top(changes: DataFrame, k: int = 7) -> DataFrame:
    """The k most material changes of each pair, in change order.

    The rank limit is applied on every partition before the shuffle, so a pair
    with most of the changes does not land in one task.
    """
    order = W.partitionBy("to_seq").orderBy(materiality_rank(F.col("materiality")), F.length("change_id"), "change_id")
    ranked = material_only(changes).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k)


def pair_summary(changes: DataFrame) -> DataFrame:
    """Long form: count per pair, section and value."""
    sections = F.explode(F.array(
        F.struct(F.lit("materiality").alias("section"), F.col("materiality").alias("value")),
        F.struct(F.lit("change_type").alias("section"), F.col("change_type").alias("value")),
        F.struct(F.lit("all").alias("section"), F.lit("all").alias("value"))))
    rows = changes.select("from_snapshot_id", "to_snapshot_id", sections.alias("s"))
    return rows.groupBy("from_snapshot_id", "to_snapshot_id", "s.section", "s.value").agg(F.count(F.lit(1)).alias("n"))


def notification_candidates(changes: DataFrame) -> DataFrame:
    """Changes of the newest pair with the decision to notify."""
    newest = changes.agg(F.max("to_seq").alias("to_seq"))
    due = materiality_rank(F.col("materiality")) <= materiality_rank(F.lit("HIGH"))
    rows = changes.join(newest, "to_seq").dropDuplicates(["change_id"])
    return rows.select(
        "change_id", "materiality", F.concat_ws(":", "object_type", "object_id").alias("object"),
        F.col("technical_summary").alias("summary"), "to_snapshot_id", "effective_at", "observed_at",
        due.alias("should_notify"),
        F.when(due, "materiality>=HIGH").otherwise("below the notification floor (HIGH)").alias("notification_reason"))
