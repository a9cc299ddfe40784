"""Source classes, independence and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import first_match, lookup
from attestra.operators.refs import usage_counts


def source_class(kind: Column, tier: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(tier.cast("string"), F.lit("")))
    return first_match(text, rules.SOURCE_CLASS_WORDS, F.lit("other"))


def is_primary_filed(tier: Column, kind: Column) -> Column:
    return F.coalesce((tier == 1) & kind.rlike("(?i)" + rules.PRIMARY_FILED_WORDS), F.lit(False))


def materiality_of_text(text: Column) -> Column:
    words = [("high", rules.HIGH_MATERIALITY_WORDS), ("moderate", rules.MODERATE_MATERIALITY_WORDS)]
    return first_match(F.coalesce(text, F.lit("")), words, F.lit("low"))


def confidence_of(status: Column) -> Column:
    return (
        F.when(status.isin("VERIFIED_PRIMARY", "CORROBORATED"), "high")
        .when(status == "CONTRADICTED", "disputed")
        .when(status.isNotNull(), "low")
    )


def _cited(records: DataFrame, key: str, model: DataFrame, keep: list[str]) -> DataFrame:
    """Per record: how its sources look in the source model.

    The sets are at most as long as one record's own source array.
    """
    exploded = records.select(key, *keep, F.explode_outer("sources").alias("source_id"))
    joined = exploded.join(model, "source_id", "left")
    upstream = F.when(F.col("source_id").isNotNull(), F.coalesce("upstream", F.lit("unknown")))
    return joined.groupBy(key, *keep).agg(
        F.count("source_id").alias("source_records"),
        F.array_sort(F.collect_set(upstream)).alias("upstreams"),
        F.count_if(F.col("class") == "primary_registry_document").alias("primary_direct_count"),
        F.coalesce(F.bool_and(F.coalesce(F.col("controlled"), F.lit(False))), F.lit(False)).alias("_all_controlled"),
    )


def with_control(model: DataFrame, controlled_upstream: str) -> DataFrame:
    return model.select("source_id", "upstream", "class", (F.col("upstream") == controlled_upstream).alias("controlled"))


def source_diversity(claims: DataFrame, model: DataFrame, controlled_upstream: str) -> DataFrame:
    """Independent support per claim: authorities are counted, not copies."""
    slim = claims.select("id", "status", materiality_of_text(F.col("text")).alias("materiality"), "sources")
    rows = _cited(slim, "id", with_control(model, controlled_upstream), ["status", "materiality"])
    upstreams = F.size("upstreams")
    company_only = (F.col("source_records") > 0) & F.col("_all_controlled")
    note = F.when((upstreams <= 1) & (F.col("status") == "CORROBORATED"), "several records of one authority").when(
        company_only, "first-party source only")
    return rows.select("id", "status", "materiality", "source_records", upstreams.alias("independent_upstreams"), "upstreams",
                       "primary_direct_count", company_only.alias("company_controlled_only"),
                       (upstreams <= 1).alias("monoculture"), note.alias("note"))


def independent_families(citations: DataFrame, families: DataFrame) -> DataFrame:
    """Distinct source families per claim; an unmapped source is its own.

    ``citations``: claim_id, source_id.
    """
    joined = citations.join(families, "source_id", "left")
    return joined.groupBy("claim_id").agg(F.countDistinct(F.coalesce("family_id", "source_id")).alias("independent_families"))


def verification_state(edges: DataFrame, model: DataFrame, controlled_upstream: str, register_upstreams: list[str]) -> DataFrame:
    """An edge never looks more certain than its evidence."""
    rows = _cited(edges, "id", with_control(model, controlled_upstream), ["source", "target", "status", "valid_to"])
    upstreams = F.size("upstreams")
    register = F.arrays_overlap("upstreams", F.array(*[F.lit(u) for u in register_upstreams]))
    status = F.col("status")
    company_only = (F.col("source_records") > 0) & F.col("_all_controlled")
    state = (
        F.when(status == "CONTRADICTED", "contradicted")
        .when(F.col("valid_to").isNotNull(), "historical")
        .when((status == "VERIFIED_PRIMARY") & ((F.col("primary_direct_count") > 0) | register), "verified")
        .when((status == "CORROBORATED") & (upstreams >= 2), "partially_verified")
        .when(status == "CORROBORATED", "single_upstream")
        .when(company_only | (status == "SELF_REPORTED"), "source_claimed")
        .otherwise("unverified")
    )
    return rows.select("id", "source", "target", "status", state.alias("verification_state"),
                       upstreams.alias("independent_upstreams"), F.col("source_records"),
                       (F.col("primary_direct_count") > 0).alias("has_primary_direct"))


def source_registry(sources: DataFrame, model: DataFrame, cutoff: str, controlled_upstream: str,
                    citing: list[tuple[str, DataFrame, str, str]], window_days: int = 14) -> DataFrame:
    """Sources with class, upstream, independence, freshness and use."""
    counts = usage_counts(sources, citing)
    rows = sources.withColumnRenamed("id", "source_id").join(model, "source_id", "left").join(counts, "source_id", "left")
    age = F.abs(F.datediff(F.lit(cutoff).cast("date"), F.to_date("retrievedAt")))
    independence = (
        F.when(F.col("upstream") == controlled_upstream, "company_controlled")
        .when(F.col("class").contains("aggregator") | F.col("class").contains("mirror"), "derivative")
        .otherwise("independent_origin")
    )
    freshness = F.when(F.col("retrievedAt").isNull(), "unknown").when(age <= window_days, "fresh").otherwise("aged")
    return rows.select("source_id", "tier", "kind", "class", "upstream", "official", "primary", independence.alias("independence"),
                       freshness.alias("freshness"), "retrievedAt", *[k for k, *_ in citing])


def lineage(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim, position, source) rows with what is known about the source."""
    cited = claims.select("id", "status", F.posexplode("sources").alias("pos", "source_id"))
    known = sources.select(F.col("id").alias("source_id"), "title", "tier", "kind", "retrievedAt")
    joined = cited.join(known, "source_id", "left")
    return joined.select("id", "status", "pos", "source_id",
                         F.when(F.col("title").isNull(), "other").otherwise(source_class(F.col("kind"), F.col("tier"))).alias("source_class"),
                         "title", "tier", "retrievedAt", is_primary_filed(F.col("tier"), F.col("kind")).alias("primary_filed"))


def supersession_links(claims: DataFrame) -> DataFrame:
    """(claim, successor) rows; the reverse reading gives predecessors.

    A successor that does not exist is marked dangling.
    """
    forward = claims.filter(F.size("supersededBy") > 0).select(F.col("id").alias("claim_id"), F.explode("supersededBy").alias("successor_id"))
    ids = claims.select(F.col("id").alias("successor_id"), F.lit(True).alias("_known"))
    joined = forward.join(ids, "successor_id", "left")
    return joined.select("claim_id", "successor_id", F.col("_known").isNull().alias("dangling"))


def source_rollup(sources: DataFrame, artifacts: DataFrame, spans: DataFrame, availability: DataFrame, claims: DataFrame) -> DataFrame:
    """Counts of artifacts, spans and claims per source, and last availability."""
    count = lambda df, name: df.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    last = availability.groupBy("source_id").agg(
        F.max_by("status", F.struct("last_checked", "url")).alias("availability"), F.max("last_checked").alias("last_checked"))
    cited = claims.select(F.explode(F.array_distinct("sources")).alias("source_id"))
    rows = sources.select(F.col("id").alias("source_id"))
    for part in (count(artifacts, "artifacts"), count(spans, "spans"), count(cited, "claims")):
        rows = rows.join(part, "source_id", "left")
    rows = rows.join(last, "source_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return rows.select("source_id", zero("artifacts"), zero("spans"), zero("claims"), "availability", "last_checked")


def risk_basis(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Share of self-reported claims among the live claims behind each risk.

    ``links``: risk_id, claim_id.
    """
    live = claims.filter("NOT superseded").select(F.col("id").alias("claim_id"), "status")
    rows = links.join(live, "claim_id").groupBy("risk_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "SELF_REPORTED").alias("self_reported"))
    pct = F.round(F.col("self_reported").cast("decimal(20,6)") * 100 / F.col("claims"), 1)
    text = F.concat(F.col("self_reported"), F.lit(" of "), F.col("claims"), F.lit(" claims are self-reported"))
    return rows.select("risk_id", "claims", "self_reported", pct.cast("double").alias("share_pct"), text.alias("basis"))


def status_priority(priority: Column) -> Column:
    return lookup(priority, {"high": 3, "medium": 2, "low": 1})
