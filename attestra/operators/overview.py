"""Tallies, KPIs, fingerprints, search and the event timeline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attestra.functions.text import fnv1a32
from attestra.functions.time import year_of
from attestra.operators.extract import union_all
from attestra.session import cut_lineage


def tally(df: DataFrame, key: str) -> DataFrame:
    """Counts per value; nulls are not counted."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def claim_accounting(claims: DataFrame) -> DataFrame:
    """Issued = live + superseded, and counts by status, as (measure, value)."""
    totals = claims.agg(F.count(F.lit(1)).alias("issued"), F.count_if(~F.col("superseded")).alias("live"), F.count_if("superseded").alias("superseded"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in ("issued", "live", "superseded")])).alias("m")).select("m.*")
    by_status = tally(claims, "status").select(F.concat(F.lit("status:"), "status").alias("measure"), F.col("n").alias("value"))
    return totals.unionByName(by_status)


def claim_ids(claims: DataFrame) -> DataFrame:
    """The id lists behind the accounting, as (list, id) rows."""
    return claims.select(F.when(F.col("superseded"), "superseded").otherwise("live").alias("list"), "id")


def state_fingerprint(counts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Named counts of a case and one short hash over them.

    Each table comes down to one count before the counts meet.
    """
    rows = union_all([df.agg(F.lit(i).alias("i"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("value")) for i, (name, df) in enumerate(counts)])
    wide = rows.agg(F.array_sort(F.collect_list(F.struct("i", "name", "value"))).alias("c"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x["value"].cast("string"))), ","), F.lit("}"))
    return wide.select(text.alias("fingerprint"), fnv1a32(text).alias("run_hash"))


def kpi_rows(claims: DataFrame, contradictions: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame) -> DataFrame:
    """(kpi, id) rows: every number can be traced to the ids it counts."""
    live = claims.filter("NOT superseded")
    pick = lambda df, name, cond=None: (df if cond is None else df.filter(cond)).select(F.lit(name).alias("kpi"), F.col("id").cast("string").alias("id"))
    official = (F.col("tier") == 1) | F.col("kind").rlike("(?i)official|government|register|VIES|justice|ARES|Sbírka")
    document = F.col("kind").rlike("(?i)primary registry document|filed financial|court (execution|notice)")
    return union_all([
        pick(live, "claims"), pick(live, "verified", F.col("status").isin("VERIFIED_PRIMARY", "CORROBORATED")),
        pick(live, "self_reported", F.col("status") == "SELF_REPORTED"), pick(live, "assessed", F.col("status") == "ASSESSED"),
        pick(contradictions, "contradictions"), pick(contradictions, "contradictions_resolved", F.col("status") == "RESOLVED"),
        pick(sources, "sources"), pick(sources, "official_sources", official), pick(sources, "primary_documents", document),
        pick(nodes, "entities"), pick(edges, "relationships"), pick(questions, "open_questions")])


def kpi_overview(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kpi").agg(F.count(F.lit(1)).alias("value"))


def search_index(kinds: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(kind_rank, kind, id, label) of everything that can be found."""
    return union_all([df.select(F.lit(i).alias("kind_rank"), F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"))
                      for i, (kind, df, key, label) in enumerate(kinds)])


def search(index: DataFrame, text: str, k: int = 12, min_length: int = 2) -> DataFrame:
    """Records whose id or label contains the text; an exact id comes first."""
    q = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", "id", F.coalesce("label", F.lit(""))))
    found = index.filter(hay.contains(q) if len(q) >= min_length else F.lit(False))
    return found.orderBy((F.lower("id") == q).desc(), "kind_rank", "id").limit(k)


def citing(records: DataFrame, out: str) -> DataFrame:
    """Bridge table (record, source_id): each source of each record once."""
    return records.select(F.col("id").alias(out), F.explode(F.array_distinct("sources")).alias("source_id")).filter("source_id IS NOT NULL").distinct()


def related_bridges(metrics: DataFrame, claims: DataFrame, words: str) -> tuple[DataFrame, DataFrame]:
    """(metric_id, source_id) and (source_id, claim_id): the relation of metrics and finance claims.

    A metric and a claim are related if they share a source. Two bridge tables
    say that in as many rows as there are citations; a source that a third of
    both cites would otherwise give a row for each pair. ``resolve_related``
    spells the pairs out for the metrics that are asked for.
    """
    finance = claims.filter(F.col("text").rlike("(?i)" + words))
    return citing(metrics, "metric_id"), citing(finance, "claim_id").select("source_id", "claim_id")


def _classes(bridge: DataFrame, member: str) -> DataFrame:
    """Members with the same sources are one class: (class, rep, n, sources)."""
    named = _classed(bridge, member)
    return named.groupBy("class").agg(F.min(member).alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("sources").alias("sources"))


def _classed(bridge: DataFrame, member: str) -> DataFrame:
    sets = bridge.groupBy(member).agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    return sets.withColumn("class", F.sha2(F.to_json("sources"), 256))


def related_classes(own: DataFrame, cited: DataFrame) -> DataFrame:
    """(part, id, ref) rows: the whole relation of metrics and claims, without its square.

    Members with the same sources have the same relations and form a class named
    by its smallest id. ``metric`` and ``claim`` rows tell the class (ref) of
    each member (id); ``related`` rows pair the classes that share a source.
    """
    def members(part, bridge, member, classes):
        named = _classed(bridge, member).join(classes.select("class", "rep"), "class")
        return named.select(F.lit(part).alias("part"), F.col(member).alias("id"), F.col("rep").alias("ref"))

    a, b = _classes(own, "metric_id"), _classes(cited, "claim_id")
    left = a.select(F.col("rep").alias("id"), F.explode("sources").alias("source_id"))
    right = b.select(F.col("rep").alias("ref"), F.explode("sources").alias("source_id"))
    pairs = left.join(right, "source_id").select(F.lit("related").alias("part"), "id", "ref").distinct()
    return union_all([members("metric", own, "metric_id", a), members("claim", cited, "claim_id", b), pairs])


def related_counts(own: DataFrame, cited: DataFrame) -> DataFrame:
    """(metric_id, related_claims): how many distinct claims share a source with each metric.

    Claims with the same sources are counted as one class, and so are metrics,
    so the pairs that are formed are pairs of distinct source sets.
    """
    a, b = _classes(own, "metric_id"), _classes(cited, "claim_id")
    left = a.select(F.col("class").alias("_a"), F.explode("sources").alias("source_id"))
    right = b.select(F.col("class").alias("_b"), "n", F.explode("sources").alias("source_id"))
    pairs = left.join(right, "source_id").groupBy("_a", "_b").agg(F.any_value("n").alias("n"))
    counts = pairs.groupBy("_a").agg(F.sum("n").alias("related_claims"))
    members = own.groupBy("metric_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("source_id"))), 256).alias("_a"))
    return members.join(counts, "_a", "left").select("metric_id", F.coalesce("related_claims", F.lit(0)).alias("related_claims"))


def resolve_related(asked: DataFrame, own: DataFrame, cited: DataFrame) -> DataFrame:
    """(metric_id, claim_id) pairs of the metrics in ``asked`` (metric_id) only."""
    return own.join(asked.select("metric_id").distinct(), "metric_id", "left_semi").join(cited, "source_id").select("metric_id", "claim_id").distinct()


# Vocabulary of claims that can explain a figure.
FINANCE_WORDS = "revenue|financ|zisk|result|assets|equity|liabilit|náklad|tržb"


def combine_events(timeline: DataFrame, edges: DataFrame, sources: DataFrame, snapshots: DataFrame, publication: DataFrame) -> DataFrame:
    """Events of three lanes that never mix: reality, evidence, publication.

    Relationship dates that are already milestones are left out; retrievals are
    kept once per source and day.
    """
    shape = lambda df, kind, lane, date, text, key: df.select(
        F.col(date).alias("date"), F.lit(kind).alias("kind"), F.lit(lane).alias("lane"), text.alias("text"), key.alias("key"))
    fresh = edges.filter("first_observed IS NOT NULL").join(timeline.select(F.col("date").alias("first_observed")).distinct(), "first_observed", "left_anti")
    seen = sources.filter("retrievedAt IS NOT NULL").dropDuplicates(["retrievedAt", "id"])
    return union_all([
        shape(timeline, "milestone", "reality", "date", F.col("event"), F.concat(F.lit("m"), "id")),
        shape(fresh, "rel", "reality", "first_observed", F.concat_ws(" - ", "source", "label", "target"), F.concat(F.lit("e"), "id")),
        shape(seen, "obs", "evidence", "retrievedAt", F.concat(F.col("id"), F.lit(" retrieved")), F.concat(F.lit("s"), "id")),
        shape(snapshots, "pub", "publication", "generated_at", F.concat(F.lit("snapshot "), "snapshot_id"), F.concat(F.lit("p"), "snapshot_id")),
        shape(publication, "pub", "publication", "at", F.col("event"), F.concat(F.lit("pe"), "id"))])


def sort_events(events: DataFrame) -> DataFrame:
    return events.orderBy("date", "lane", "key")


def timeline_filter(events: DataFrame, scope: str = "all", lane: str | None = None, year: int | None = None) -> DataFrame:
    if scope == "milestone":
        events = events.filter("kind = 'milestone'")
    if lane is not None:
        events = events.filter(F.col("lane") == lane)
    if year is not None:
        events = events.filter(year_of(F.col("date")) == year)
    return events


def mention_key(label: Column) -> Column:
    """Last word of a label without a leading initial, lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "^[a-z]\\.\\s*", "")
    return F.element_at(F.split(plain, "\\s+"), -1)


#: Keys, and characters of keys, of one automaton; it is sent to every task.
AUTOMATON_KEYS = 100_000
AUTOMATON_CHARS = 4_000_000


def _key_blocks(keys: DataFrame, most_keys: int, most_chars: int) -> tuple[DataFrame, int]:
    """``keys`` (_key, id) dealt into blocks of bounded size by their hash."""
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_key") + F.length("id")).alias("chars")).first()
    # dealt at random, so twice the blocks leave room for uneven ones
    blocks = max(-(-whole.n // most_keys), -(-(whole.chars or 0) // most_chars))
    blocks = blocks if blocks <= 1 else 2 * blocks
    return keys.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(max(blocks, 1)))), blocks


def _automaton(keys: list[tuple[str, str]]):
    """Aho-Corasick automaton of the keys: one walk over a text finds all that occur in it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, node in keys:
        automaton.add_word(key, (len(key), key, node))
    automaton.make_automaton()
    return automaton


def _walk(keys: list[tuple[str, str]], longest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(keys)
        for batch in batches:
            at, nodes, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = {hit for _, hit in automaton.iter(text)} if text else set()
                if hits and longest_only:
                    longest = max(n for n, _, _ in hits)
                    hits = {min((h for h in hits if h[0] == longest), key=lambda h: h[2])}
                for _, key, node in hits:
                    at.append(i)
                    nodes.append(node)
                    found.append(key)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.string()), pa.array(found, pa.string())], ["text_id", "node_id", "mention_key"])

    return run


def _mentions(texts: DataFrame, keys: DataFrame, key: str, text: str, longest_only: bool, most_keys: int, most_chars: int) -> DataFrame:
    """(text_id, node_id, mention_key) of every text and every key that occurs in it, or of the longest in each block."""
    dealt, blocks = _key_blocks(keys, most_keys, most_chars)
    dealt = cut_lineage(dealt) if blocks > 1 else dealt
    lowered = texts.select(F.col(key).alias("text_id"), F.lower(text).alias("text"))
    schema = StructType([StructField("text_id", lowered.schema["text_id"].dataType), StructField("node_id", StringType()), StructField("mention_key", StringType())])
    parts = []
    for b in range(blocks):
        # a block is bounded, so it may stand in the task; texts are read once for each block
        block = [(r["_key"], r["id"]) for r in dealt.filter(F.col("_block") == b).select("_key", "id").collect()]
        if block:
            parts.append(lowered.mapInArrow(_walk(block, longest_only), schema))
    return union_all(parts) if parts else texts.sparkSession.createDataFrame([], schema)


def _keys(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", mention_key(F.col("label")).alias("_key")).filter(F.length("_key") > 3)


def mention_entities(texts: DataFrame, nodes: DataFrame, key: str = "id", text: str = "text", most_keys: int = AUTOMATON_KEYS, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(text id, node) pairs where the node's key occurs inside the text.

    Every distinct key is in one automaton of a bounded block of keys, which a
    text is walked through once; the nodes of a key are joined to what was
    found. Null texts hold nothing.
    """
    keys = _keys(nodes)
    found = _mentions(texts, keys.groupBy("_key").agg(F.min("id").alias("id")), key, text, False, most_keys, most_chars)
    return found.select("text_id", "mention_key").join(keys.select(F.col("id").alias("node_id"), F.col("_key").alias("mention_key")), "mention_key").select("text_id", "node_id", "mention_key")


def mention_entity(texts: DataFrame, nodes: DataFrame, key: str = "id", text: str = "text", most_keys: int = AUTOMATON_KEYS, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The node with the longest key found in each text; smallest id on a tie.

    Only the smallest id of a key can win, and only the longest key of a block,
    so a text gives one row for each block of keys.
    """
    best = _keys(nodes).groupBy("_key").agg(F.min("id").alias("id"))
    hits = _mentions(texts, best, key, text, True, most_keys, most_chars)
    return hits.groupBy("text_id").agg(F.min_by("node_id", F.struct(-F.length("mention_key"), F.col("node_id"))).alias("node_id"))
