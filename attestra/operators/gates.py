"""Data-quality gates. Every family returns (gate, level, object_id, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules as K
from attestra.functions import text as X
from attestra.operators.classify import materiality_rank
from attestra.operators.extract import union_all
from attestra.operators.refs import bridge


def _empty(col: str) -> Column:
    return F.coalesce(F.size(col) <= 0, F.lit(True))


def _blank(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string") == "", F.lit(True))


def check_rows(df: DataFrame, gate: str, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """All row rules of one table in a single pass. Checks: (rule, level, failing)."""
    hits = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for rule, level, bad in checks]
    rows = df.select(F.col(key).cast("string").alias("object_id"), F.explode(F.array_compact(F.array(*hits))).alias("c"))
    return rows.select(F.lit(gate).alias("gate"), "c.level", "object_id", "c.rule")


def _as_findings(df: DataFrame, gate: str, rule: str, key: str, level: str = "error") -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.lit(level).alias("level"), F.col(key).cast("string").alias("object_id"), F.lit(rule).alias("rule"))


def check_refs(df: DataFrame, gate: str, rule: str, key: str, refs: str, known: DataFrame, known_id: str = "id", level: str = "error") -> DataFrame:
    """One finding per reference of an array that resolves to nothing."""
    bad = bridge(df, key, refs).join(known.select(F.col(known_id).alias("ref")), "ref", "left_anti")
    return _as_findings(bad, gate, rule, key, level)


def check_ref(df: DataFrame, gate: str, rule: str, key: str, ref: str, known: DataFrame, known_id: str = "id") -> DataFrame:
    bad = df.filter(F.col(ref).isNotNull()).select(F.col(key), F.col(ref).alias("_ref")).join(known.select(F.col(known_id).alias("_ref")), "_ref", "left_anti")
    return _as_findings(bad, gate, rule, key)


def check_present(expected: DataFrame, gate: str, rule: str, key: str, found: DataFrame, found_id: str, level: str = "error") -> DataFrame:
    """Records that must appear in another table and do not."""
    miss = expected.join(found.select(F.col(found_id).alias(key)), key, "left_anti")
    return _as_findings(miss, gate, rule, key, level)


def check_unique(df: DataFrame, gate: str, rule: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _as_findings(twice.withColumn("_id", F.concat_ws(":", *keys)), gate, rule, "_id")


def assert_clean(findings: DataFrame) -> None:
    """Raise when any error-level finding exists; shows at most ten."""
    bad = findings.filter("level = 'error'").limit(10).collect()
    if bad:
        raise AssertionError("; ".join(f"[{r.gate}] {r.rule} {r.object_id}" for r in bad))


def reconcile_sets(semantic: DataFrame, recorded: DataFrame, gate: str = "changes") -> DataFrame:
    """Both one-sided differences of two key sets; each must be empty."""
    a, b = semantic.select("key").distinct(), recorded.select("key").distinct()
    return _as_findings(a.join(b, "key", "left_anti"), gate, "DIFFERENCE_WITHOUT_RECORD", "key").unionByName(
        _as_findings(b.join(a, "key", "left_anti"), gate, "RECORD_WITHOUT_DIFFERENCE", "key"))


# ------------------------------------------------------------ families


def sourcing(claims: DataFrame, identity: DataFrame, sources: DataFrame) -> DataFrame:
    g = "sourcing"
    return union_all([
        check_rows(claims, g, "id", [("CLAIM_NO_SOURCE", "error", _empty("sources"))]), check_refs(claims, g, "CLAIM_BAD_SOURCE", "id", "sources", sources),
        check_rows(identity, g, "id", [("IDENTITY_NO_SOURCE", "error", _empty("sources"))]), check_refs(identity, g, "IDENTITY_BAD_SOURCE", "id", "sources", sources)])


def edges(links: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    g = "edges"
    return union_all([
        check_ref(links, g, "EDGE_BAD_NODE", "id", "source", nodes), check_ref(links, g, "EDGE_BAD_NODE", "id", "target", nodes),
        check_rows(links, g, "id", [("EDGE_NO_SOURCE", "error", _empty("sources")), ("EDGE_NO_WHY", "error", _blank("why"))]),
        check_refs(links, g, "EDGE_BAD_SOURCE", "id", "sources", sources)])


def contradictions(cons: DataFrame, sources: DataFrame) -> DataFrame:
    """``cons``: id, status, source_a, source_b, resolved_by, resolved_at."""
    g = "contradictions"
    resolved = F.col("status") == "RESOLVED"
    sides = cons.select("id", F.array_compact(F.array("source_a", "source_b")).alias("refs"))
    return union_all([
        check_rows(cons, g, "id", [
            ("CON_INCOMPLETE", "error", F.col("source_a").isNull() | F.col("source_b").isNull()),
            ("CON_RESOLVED_UNGROUNDED", "error", resolved & (_empty("resolved_by") | _blank("resolved_at"))),
            ("CON_STATUS", "warn", ~F.coalesce(F.col("status").isin("RESOLVED", "CONTRADICTED"), F.lit(False)))]),
        check_refs(sides, g, "CON_BAD_SOURCE", "id", "refs", sources), check_refs(cons.filter(resolved), g, "CON_BAD_SOURCE", "id", "resolved_by", sources)])


def privacy(texts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``texts``: id, text of every export. ``expected``: id of exports."""
    found = check_rows(texts, "privacy", "id", [("PII_BIRTH_NUMBER", "error", X.has_birth_number(F.col("text")))])
    if expected is None:
        return found
    return found.unionByName(check_present(expected.select("id").distinct(), "privacy", "EXPORT_MISSING", "id", texts.select("id").distinct(), "id"))


def derivation(derived: DataFrame, hypotheses: DataFrame, known: DataFrame) -> DataFrame:
    """``derived``: id, derived_from of gaps, hypotheses and tasks."""
    g = "derivation"
    return union_all([
        check_refs(derived, g, "DERIVED_ORPHAN", "id", "derived_from", known), check_rows(derived, g, "id", [("DERIVED_NO_PROV", "warn", _empty("derived_from"))]),
        check_rows(hypotheses, g, "id", [
            ("HYP_BAD_STATE", "error", ~F.col("state").isin(K.HYPOTHESIS_STATES)), ("HYP_AS_FACT", "error", F.col("state").isin("VERIFIED_PRIMARY", "CORROBORATED")),
            ("HYP_NO_FALSIFICATION", "error", _blank("falsification"))])])


def coverage(matrix: DataFrame) -> DataFrame:
    bad = (F.col("coverage") == "absent") & (F.col("open_gaps") == 0)
    return check_rows(matrix, "coverage", "dimension", [("ABSENT_NO_GAP", "error", bad)])


def frontier(gaps: DataFrame, dimensions: DataFrame, cons: DataFrame, tasks: DataFrame) -> DataFrame:
    covered = tasks.select(F.explode("derived_from").alias("ref"))
    return union_all([
        check_ref(gaps, "frontier", "GAP_BAD_DIM", "id", "dimension", dimensions, "dimension"),
        check_present(cons.select("id"), "frontier", "CON_NO_TASK", "id", covered, "ref")])


def addresses(rows: DataFrame, sources: DataFrame, published_natural_persons: int = 0) -> DataFrame:
    """``rows``: id, publication, owner_type, resolution, sources, the collected
    flags and the cadastral values they must cover."""
    g = "addresses"
    invented = lambda value, flag: ~_blank(value) & ~F.coalesce(F.col(flag), F.lit(False))
    found = union_all([
        check_rows(rows, g, "id", [
            ("CAD_PUB_CLASS", "error", ~F.col("publication").isin(K.PUBLIC_ADDRESS_CLASSES)), ("CAD_NATURAL_PERSON", "error", F.col("owner_type") != "legal_entity"),
            ("CAD_NO_SOURCE", "error", _empty("sources")), ("CAD_AMBIGUOUS_PUBLISHED", "error", F.col("resolution") == "ambiguous"),
            ("CAD_INVENTED_RUIAN", "error", invented("ruian_id", "collected_ruian")), ("CAD_INVENTED_GEOMETRY", "error", invented("coordinates", "collected_geometry")),
            ("CAD_INVENTED_PARCEL", "error", ~_empty("parcels") & ~F.coalesce("collected_parcel", F.lit(False))),
            ("CAD_INVENTED_OWNERSHIP", "error", invented("ownership", "collected_ownership"))]),
        check_refs(rows, g, "CAD_BAD_SOURCE", "id", "sources", sources)])
    if published_natural_persons:
        one = rows.agg(F.lit("manifest").alias("id"))
        found = found.unionByName(_as_findings(one, g, "CAD_NP_COUNT", "id"))
    return found


def investigation(registry: DataFrame, sources: DataFrame, diversity: DataFrame, tasks: DataFrame, questions: DataFrame, verification: DataFrame, known: DataFrame) -> DataFrame:
    g = "planner"
    return union_all([
        check_ref(registry, g, "PLAN_SRC_UNKNOWN", "source_id", "source_id", sources),
        check_rows(registry, g, "source_id", [("PLAN_SRC_NO_UPSTREAM", "warn", _blank("upstream") | (F.col("upstream") == "unknown"))]),
        check_rows(diversity, g, "id", [
            ("PLAN_DIV_IMPOSSIBLE", "error", F.col("independent_upstreams") > F.col("source_records")),
            ("PLAN_MONOCULTURE_UNFLAGGED", "error", F.col("monoculture") & (F.col("status") == "CORROBORATED") & _blank("note"))]),
        check_rows(tasks, g, "id", [
            ("PLAN_TASK_NO_EIG", "error", ~F.coalesce(F.col("information_gain").isin(K.INFORMATION_GAIN), F.lit(False))),
            ("PLAN_TASK_NO_ORIGIN", "error", _empty("derived_from")), ("PLAN_TASK_NO_WHY", "error", _blank("why_ranked"))]),
        check_refs(tasks, g, "PLAN_TASK_ORPHAN", "id", "derived_from", known),
        check_ref(questions, g, "PLAN_Q_NO_TASK", "id", "linked_task", tasks),
        check_rows(verification, g, "id", [("PLAN_VERIF_IMPOSSIBLE", "error", F.col("independent_upstreams") > F.col("source_records"))])])


def evidence(claims: DataFrame, inventory: DataFrame | None, published: DataFrame | None, files: DataFrame, spans: DataFrame | None, exports: DataFrame) -> DataFrame:
    """``published``: id, sha256, pub_class, download. ``files``: path, sha256.
    ``spans``: id, verified, exact_text, page, document. ``exports``: id, text.

    Where the inventory, the published artifacts or the spans were not built
    (None), that is the only finding. ``outputs.evidence_files`` finds the same
    from the files of many cases.
    """
    g = "evidence"
    if inventory is None or published is None or spans is None:
        return _as_findings(_one_row(claims, "evidence"), g, "EVIDENCE_MISSING", "_id")
    live = claims.filter("NOT superseded").select(F.col("id").alias("claim_id"))
    gone = claims.filter("superseded")
    shown = inventory.select("claim_id", "category")
    absent = claims.filter("status = 'NOT_FOUND'").select(F.col("id").alias("claim_id")).join(shown.filter("category = 'BLOCKED'"), "claim_id", "left_semi")
    stored = published.filter("download IS NOT NULL").join(files.select(F.col("path").alias("download"), F.col("sha256").alias("file_sha")), "download", "left")
    text = F.col("text")
    return union_all([
        check_present(live, g, "CLAIM_NO_EVIDENCE", "claim_id", shown, "claim_id"),
        _as_findings(gone.select(F.col("id").alias("claim_id")).join(shown, "claim_id", "left_semi"), g, "SUPERSEDED_LIVE", "claim_id"),
        _as_findings(absent, g, "BLOCKED_AS_NOTFOUND", "claim_id"),
        check_rows(gone, g, "id", [("SUPERSEDED_NO_SUCCESSOR", "error", _empty("supersededBy"))]),
        check_refs(gone, g, "SUPERSEDED_BAD_SUCCESSOR", "id", "supersededBy", live, "claim_id"),
        check_rows(stored, g, "id", [
            ("ARTIFACT_FILE_MISSING", "error", F.col("file_sha").isNull()), ("ARTIFACT_HASH_MISMATCH", "error", F.col("file_sha") != F.col("sha256")),
            ("RESTRICTED_PUBLISHED", "error", F.col("pub_class").startswith("RESTRICTED")), ("ARTIFACT_PATH_LEAK", "error", ~F.col("download").startswith("/data/"))]),
        check_rows(spans, g, "id", [
            ("SPAN_UNVERIFIED", "error", ~F.coalesce("verified", F.lit(False))), ("SPAN_INCOMPLETE", "error", _blank("exact_text") | F.col("page").isNull() | _blank("document"))]),
        check_rows(exports, g, "id", [("PATH_LEAK", "error", X.has_local_path(text)), ("PII_BIRTH_NUMBER", "error", X.has_birth_number(text)), ("PII_FULL_BIRTHDATE", "error", X.has_full_birth_date(text))])])


def evidence_build(claims: DataFrame, link_refs: DataFrame, selectors: DataFrame, citations: DataFrame, quotes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Errors of the evidence build, from the resolved parts.

    ``link_refs``: result of ``resolve_links``; ``selectors``: result of
    ``selector_counts``; ``citations`` and ``quotes``: verified flags;
    ``artifacts``: result of ``verify_artifacts``.
    """
    g = "evidence build"
    bad_refs = link_refs.filter("NOT resolved").select(
        F.lit(g).alias("gate"), F.lit("error").alias("level"), F.col("claim_id").alias("object_id"), F.concat(F.lit("LINK_UNKNOWN_"), F.upper("space")).alias("rule"))
    linked = link_refs.select("claim_id").distinct()
    live = claims.filter("NOT superseded").select(F.col("id").alias("claim_id"))
    gone = claims.filter("superseded").select(F.col("id").alias("claim_id"))
    return union_all([
        bad_refs,
        check_present(live, g, "LIVE_CLAIM_WITHOUT_EVIDENCE", "claim_id", linked, "claim_id"),
        _as_findings(gone.join(linked, "claim_id", "left_semi"), g, "SUPERSEDED_WITH_LINKS", "claim_id"),
        _as_findings(selectors.filter("matches = 0"), g, "SELECTOR_EMPTY", "selector_id"),
        check_rows(citations, g, "id", [("SPAN_FILE_MISSING", "error", F.col("match") == "file missing"), ("SPAN_TEXT_NOT_FOUND", "error", F.col("match") == "not found")]),
        check_rows(quotes, g, "id", [("QUOTE_NOT_FOUND", "error", F.col("missing") > 0)]),
        artifacts.select(F.lit(g).alias("gate"), F.lit("error").alias("level"), F.col("artifact_id").alias("object_id"), "rule")])


def unless(blocking: DataFrame, rest: DataFrame) -> DataFrame:
    """``rest``, or nothing of a gate that has a row in ``blocking``: its deeper rules cannot be asked."""
    # one row per gate: bounded by the gates that exist
    return rest.join(F.broadcast(blocking.select("gate").distinct()), "gate", "left_anti").select(*rest.columns)


def claim_outputs(claims: DataFrame, accounting: DataFrame, shards: DataFrame, narrative: DataFrame, routes: DataFrame,
                  listed: DataFrame | None = None, built_pages: DataFrame | None = None, built_json: DataFrame | None = None) -> DataFrame:
    """Published claim tables against the claims they come from.

    ``accounting``: measure, value as published; without rows there is no
    manifest, and its counts are not compared. ``shards``: id, proposition,
    status_explanation, path, independent_upstreams, source_records, body.
    ``narrative``: document, claim_id. ``routes``: id. ``listed``: one row per
    route that the manifest lists. ``built_pages``, ``built_json``: id of what
    the site build left; None where nothing was built.
    """
    from attestra.operators.overview import claim_accounting

    g = "claims"
    truth = claim_accounting(claims)
    told = accounting.select("measure", F.col("value").alias("told"))
    off = truth.join(told, "measure", "full_outer").filter(~F.col("value").eqNullSafe(F.col("told")))
    name = F.when(F.col("measure").startswith("status:"), "COUNT_STATUS").otherwise(F.concat(F.lit("COUNT_"), F.upper("measure")))
    counts = off.select(F.lit(g).alias("gate"), F.lit("error").alias("level"), F.col("measure").alias("object_id"), name.alias("rule"))
    value = lambda m: F.max(F.when(F.col("measure") == m, F.col("value")))
    by_status = F.sum(F.when(F.col("measure").startswith("status:"), F.col("value")))
    sums = accounting.agg(value("issued").alias("i"), value("live").alias("l"), value("superseded").alias("s"), by_status.alias("b")).withColumn("id", F.lit("accounting"))
    arithmetic = check_rows(sums, g, "id", [("COUNT_ARITHMETIC", "error", F.col("l") + F.col("s") != F.col("i")), ("COUNT_STATUS_SUM", "error", F.col("b") != F.col("i"))])
    none = accounting.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").withColumn("id", F.lit("manifest"))
    missing = _as_findings(none, g, "NO_MANIFEST", "id")
    if listed is not None:
        sizes = union_all([df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n")) for name, df in (("told", listed), ("true", claims))])
        both = sizes.agg(F.min("n").alias("least"), F.max("n").alias("most")).filter("least <> most").withColumn("id", F.lit("routes"))
        counts = counts.unionByName(_as_findings(both, g, "COUNT_ROUTES", "id"))
    slug = F.lower("id")
    body = F.col("body")
    shard = shards.join(claims.select("id", "text"), "id", "left")
    built = [] if built_pages is None else [check_present(claims.select("id"), g, "NO_ROUTE_HTML", "id", built_pages, "id")]
    if built_pages is not None and built_json is not None:
        built.append(check_present(claims.select("id"), g, "NO_JSON_PUB", "id", built_json, "id"))
    return union_all([
        missing, unless(missing, counts), *built, arithmetic, check_present(claims.select("id"), g, "NO_JSON", "id", shards, "id"), check_present(claims.select("id"), g, "NO_PAGE", "id", routes, "id"),
        check_refs(claims, g, "DANGLING_SUCCESSOR", "id", "supersededBy", claims),
        check_rows(claims.filter("superseded"), g, "id", [("SUPERSEDED_NO_SUCCESSOR", "error", _empty("supersededBy")), ("SUPERSEDED_NO_REASON", "error", _blank("supersededReason"))]),
        check_rows(shard, g, "id", [
            ("JSON_ID", "error", F.col("text").isNull()), ("JSON_NO_PROP", "error", _blank("proposition")), ("JSON_PROP_DRIFT", "error", F.col("proposition") != F.col("text")),
            ("JSON_NO_STATUS_EXPL", "error", _blank("status_explanation")), ("JSON_BAD_PATH", "error", F.col("path") != F.concat(F.lit("/claims/"), slug, F.lit("/"))),
            ("JSON_INDEP", "error", F.col("independent_upstreams") > F.col("source_records")), ("JSON_INTERNAL_PATH", "error", X.has_local_path(body)), ("JSON_PII", "error", X.has_birth_number(body))]),
        check_ref(narrative, g, "NARRATIVE_UNKNOWN_CLM", "document", "claim_id", claims)])


def finance(facts: DataFrame, metrics: DataFrame, comparisons: DataFrame, gaps: DataFrame, scale: DataFrame, reconciliations: DataFrame, exports: DataFrame) -> DataFrame:
    """``facts`` with sources; ``metrics`` with caveats; ``comparisons``: id,
    metric, classification, fact_id and the two mismatch flags; ``scale``: id,
    perimeter, caveats, source_url, fact_a, fact_b, period_a, period_b,
    derived_from."""
    g = "finance"
    refs = metrics.select("id", F.concat("numerator_facts", "denominator_facts").alias("refs"))
    compared = F.col("fact_id").isNotNull()
    text = F.col("text")
    empty = facts.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").withColumn("id", F.lit("facts"))
    unreconciled = reconciliations.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").withColumn("id", F.lit("reconciliation"))
    return union_all([
        _as_findings(empty, g, "NO_FACTS", "id"), _as_findings(unreconciled, g, "NO_RECON", "id"),
        check_rows(facts, g, "id", [
            ("FACT_NO_SOURCE", "error", _empty("sources")), ("FACT_BAD_VALUE", "error", F.col("value").isNull() | F.isnan("value")), ("FACT_NO_UNIT", "error", _blank("unit")),
            ("FACT_BAD_STATUS", "error", ~F.coalesce(F.col("status") == "FILED_FACT", F.lit(False)))]),
        check_rows(metrics, g, "id", [
            ("MET_NO_FORMULA", "error", _blank("formula")), ("MET_NO_NUM", "error", _empty("numerator_facts")), ("MET_NO_DEN", "error", _empty("denominator_facts")),
            ("MET_NO_VALUE", "error", F.col("value").isNull()), ("MET_NO_CAVEAT", "error", _blank("caveats"))]),
        check_refs(refs, g, "MET_ORPHAN_FACT", "id", "refs", facts),
        check_rows(comparisons, g, "id", [
            ("CVF_NO_PERIOD_FLAG", "error", compared & ~F.coalesce("period_mismatch", F.lit(False))), ("CVF_NO_PERIMETER_FLAG", "error", compared & ~F.coalesce("perimeter_mismatch", F.lit(False))),
            ("CVF_TARGET_AS_FACT", "error", F.col("metric").rlike("(?i)target") & ~F.coalesce(F.col("classification").rlike("(?i)TARGET|forward"), F.lit(False)))]),
        check_ref(comparisons, g, "CVF_ORPHAN_FACT", "id", "fact_id", facts),
        check_rows(gaps, g, "id", [("GAP_AS_ZERO", "error", (F.col("value") == 0) | (F.col("state") == "ZERO")), ("GAP_BAD_STATE", "error", ~F.coalesce(F.col("state").isin(K.GAP_STATES), F.lit(False)))]),
        check_rows(scale, g, "id", [
            ("CMP_NOT_LABELLED", "error", ~F.coalesce(F.col("perimeter").rlike("(?i)NON-CONSOLIDATED"), F.lit(False))), ("CMP_NO_CAVEATS", "error", _empty("caveats")),
            ("CMP_NO_PERIOD", "error", _blank("period_a") | _blank("period_b")), ("CMP_SOURCE_NO_URL", "error", _blank("source_url")), ("CMP_NO_DERIVED", "error", _empty("derived_from"))]),
        check_ref(scale, g, "CMP_ORPHAN_A", "id", "fact_a", facts), check_ref(scale, g, "CMP_ORPHAN_B", "id", "fact_b", facts),
        check_rows(exports, g, "id", [("FIN_INTERNAL_PATH", "error", X.has_local_path(text)), ("FIN_PII", "error", X.has_birth_number(text))])])


def snapshots(objects: DataFrame, manifests: DataFrame, index: DataFrame, mirror: DataFrame, current: DataFrame, live_hash: DataFrame) -> DataFrame:
    """Frozen snapshots against their own hashes.

    ``manifests``: snapshot_id, content_hash, object_manifest_hash,
    evidence_cutoff. ``index``: snapshot_id, snapshot_sequence,
    previous_snapshot_id, content_hash, evidence_cutoff. ``mirror``:
    snapshot_id, content_hash of the published copy. ``current``: snapshot_id,
    content_hash of the pointer. ``live_hash``: content_hash of the documents.
    """
    from attestra.operators.snapshot import chain_findings, object_manifest_hash, semantic_hash

    g = "snapshots"
    c = F.col
    payload = c("payload")
    rows = objects.withColumn("_id", F.concat_ws(":", "snapshot_id", "object_type", "object_id"))
    truth = semantic_hash(objects, ["snapshot_id"]).select("snapshot_id", c("content_hash").alias("_h"))
    full = object_manifest_hash(objects, ["snapshot_id"]).select("snapshot_id", c("object_manifest_hash").alias("_m"))
    chain = chain_findings(index).select(F.lit(g).alias("gate"), F.lit("error").alias("level"), c("snapshot_id").alias("object_id"), "rule")
    joined = index.select("snapshot_id", "content_hash", "evidence_cutoff").join(
        manifests.select("snapshot_id", c("content_hash").alias("_mh"), c("object_manifest_hash").alias("_om"), c("evidence_cutoff").alias("_mc")), "snapshot_id", "left")
    joined = joined.join(truth, "snapshot_id", "left").join(full, "snapshot_id", "left").join(mirror.select("snapshot_id", c("content_hash").alias("_g")), "snapshot_id", "left")
    latest = index.agg(F.max_by(F.struct("snapshot_id", "content_hash"), "snapshot_sequence").alias("l"))
    pointer = current.join(latest, current["snapshot_id"].isNotNull()).filter((c("snapshot_id") != c("l.snapshot_id")) | (c("content_hash") != c("l.content_hash")))
    drift = live_hash.select(c("content_hash").alias("_live")).join(latest, c("_live").isNotNull()).filter(c("_live") != c("l.content_hash")).select(c("l.snapshot_id").alias("snapshot_id"))
    unequal = lambda a, b: ~c(a).eqNullSafe(c(b))
    return union_all([
        chain, check_unique(objects, g, "DUPLICATE_OBJECT", ["snapshot_id", "object_type", "object_id"]),
        check_rows(rows, g, "_id", [
            ("CONTENT_HASH_MISMATCH", "error", X.content_hash(payload) != c("content_hash")), ("REVISION_ID_MALFORMED", "error", c("revision_id") != X.revision_id(c("object_id"), c("content_hash"))),
            ("VALID_TO_BEFORE_FROM", "error", c("valid_to") < c("valid_from")), ("PATH_LEAK", "error", X.has_local_path(payload)), ("PII", "error", X.has_birth_number(payload))]),
        check_rows(joined, g, "snapshot_id", [
            ("MISSING_FILES", "error", c("_mh").isNull()), ("MANIFEST_HASH", "error", c("_mh").isNotNull() & unequal("_mh", "_h")), ("INDEX_HASH", "error", c("_mh").isNotNull() & unequal("_mh", "content_hash")),
            ("OBJECT_MANIFEST_HASH", "error", c("_om").isNotNull() & unequal("_om", "_m")), ("CUTOFF_DISAGREES", "error", c("_mc").isNotNull() & unequal("_mc", "evidence_cutoff")),
            ("MIRROR_MISSING", "error", c("_g").isNull()), ("MIRROR_DIVERGES", "error", c("_g").isNotNull() & unequal("_g", "content_hash"))]),
        _as_findings(pointer, g, "CURRENT_POINTER", "snapshot_id"), _as_findings(drift, g, "CANONICAL_DRIFT", "snapshot_id")])


def snapshot_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Every snapshot of the index has a page; both sides hold snapshot_id."""
    return check_present(index.select("snapshot_id"), "changes", "SNAPSHOT_PAGE_MISSING", "snapshot_id", pages, "snapshot_id")


def changes(records: DataFrame, diffs: DataFrame, summary: DataFrame, objects: DataFrame, current_snapshot: DataFrame, routes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Published change records against a fresh diff of the snapshots.

    ``records``: change rows with change_id. ``diffs``: result of
    ``diff_chain``. ``summary``: published ``reconciliation`` rows. ``routes``:
    change_id of published pages. ``stored``: snapshot_id of the snapshots that
    can be read; a published pair with another one is a finding, and nothing
    else about that pair is compared.
    """
    from attestra.operators.changes import reconciliation

    g = "changes"
    c = F.col
    lost, every = [], records
    if stored is not None:
        pair = summary.select("from_snapshot_id", "to_snapshot_id").distinct()
        torn = union_all([pair.join(stored.select(c("snapshot_id").alias(side)), side, "left_anti") for side in pair.columns]).distinct()
        lost = [_as_findings(torn.withColumn("_id", F.concat_ws("..", "from_snapshot_id", "to_snapshot_id")), g, "PAIR_MISSING_SNAPSHOT", "_id")]
        gone = torn.select("from_snapshot_id", "to_snapshot_id")
        records, diffs, summary = (df.join(gone, gone.columns, "left_anti") for df in (records, diffs, summary))
    key = lambda df: df.select(F.concat_ws(":", "to_snapshot_id", "change_kind", "object_type", "object_id").alias("key"))
    truth = reconciliation(diffs).drop("to_identity", "from_identity", "from_snapshot_id")
    names = [n for n in truth.columns if n != "to_snapshot_id"]
    compared = summary.join(truth.select("to_snapshot_id", *[c(n).alias("_" + n) for n in names]), "to_snapshot_id", "left")
    off = [~c(n).eqNullSafe(c("_" + n)) for n in names]
    any_off = off[0]
    for o in off[1:]:
        any_off = any_off | o
    kept = c("objects_unchanged") + c("objects_changed")
    revisions = objects.select("snapshot_id", "object_type", "object_id", "revision_id")
    # both revisions of a record are looked for at once, so the objects are built and dealt out once
    side = lambda rule, at, named: F.when(c(named).isNotNull(), F.struct(F.lit(rule).alias("rule"), c(at).alias("snapshot_id"), c(named).alias("revision_id")))
    sides = F.array_compact(F.array(side("OLD_REVISION_MISSING", "from_snapshot_id", "old_revision_id"), side("NEW_REVISION_MISSING", "to_snapshot_id", "new_revision_id")))
    told = records.select("change_id", "object_type", "object_id", F.explode(sides).alias("r")).select("change_id", "object_type", "object_id", "r.*")
    nowhere = told.join(revisions, ["snapshot_id", "object_type", "object_id", "revision_id"], "left_anti")
    answers = objects.filter("object_type = 'resolved_question'").select(c("snapshot_id").alias("to_snapshot_id"), c("object_id").alias("resolved_by"))
    routed = every.join(routes.select("change_id", F.lit(True).alias("_page")), "change_id", "left")
    material = materiality_rank(c("materiality")) <= materiality_rank(F.lit("MEDIUM"))
    page = F.coalesce("_page", F.lit(False))
    stale = current_snapshot.join(every.agg(F.max(F.struct(F.length("to_snapshot_id"), "to_snapshot_id"))["to_snapshot_id"].alias("_last")), c("_last").isNotNull()).filter("snapshot_id <> _last")
    return union_all([
        *lost, _as_findings(stale, g, "MANIFEST_NOT_CURRENT", "snapshot_id"), check_unique(every, g, "DUPLICATE_ID", ["change_id"]),
        check_rows(compared, g, "to_snapshot_id", [
            ("RECONCILIATION_DRIFT", "error", any_off), ("TO_IDENTITY", "error", kept + c("objects_added") != c("to_object_count")), ("FROM_IDENTITY", "error", kept + c("objects_removed") != c("from_object_count"))]),
        reconcile_sets(key(diffs.filter("change_kind <> 'unchanged'")), key(records), g),
        nowhere.select(F.lit(g).alias("gate"), F.lit("error").alias("level"), c("change_id").cast("string").alias("object_id"), "rule"),
        _as_findings(records.filter("resolved_by IS NOT NULL").join(answers, ["to_snapshot_id", "resolved_by"], "left_anti"), g, "RESOLVED_BY_MISSING", "change_id"),
        check_rows(routed, g, "change_id", [
            ("EFFECTIVE_WITH_UNKNOWN_PRECISION", "error", c("effective_at").isNotNull() & (c("effective_time_precision") == "UNKNOWN")),
            ("MATERIAL_WITHOUT_ROUTE", "error", material & ~page), ("ROUTE_FOR_IMMATERIAL", "error", ~material & page)])])


def numbering(records: DataFrame) -> DataFrame:
    """Change ids must be CHG-0001.. in the order of ``number_changes``."""
    from attestra.operators.changes import number_changes

    again = number_changes(records.select("to_seq", "change_kind", "object_type", "object_id", F.col("change_id").alias("_told")))
    return _as_findings(again.filter("_told <> change_id"), "changes", "NUMBERING", "_told")


def _one_row(df: DataFrame, text: str) -> DataFrame:
    """One row with ``_id``, also for an empty table."""
    return df.agg(F.count(F.lit(1))).select(F.lit(text).alias("_id"))


def freshness(fresh: DataFrame, plan: DataFrame, as_of: str, cutoff: str) -> DataFrame:
    g = "freshness"
    key = ["object_type", "object_id"]
    lost = fresh.filter("current_state = 'BLOCKED'").join(plan.select(*key), key, "left_anti")
    overdue = F.col("current_state").isin("DUE", "STALE") & (F.col("materiality") == "HIGH")
    found = [
        _as_findings(lost, g, "BLOCKED_NOT_PLANNED", "object_id"), check_rows(fresh, g, "object_id", [("HIGH_OVERDUE", "warn", overdue)]),
        check_rows(plan, g, "task_id", [("TASK_NO_PROVIDER", "error", _blank("recommended_provider")), ("TASK_NO_STOP", "error", _blank("stop_condition"))])]
    if as_of != cutoff:
        found.append(_as_findings(_one_row(fresh, as_of), g, "AS_OF_DIFFERS", "_id", "warn"))
    return union_all(found)


def reasoning(inferences: DataFrame, must_have: DataFrame, known: DataFrame, superseded: DataFrame, backed: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Inference records. ``must_have``: id of assessments and conclusions.

    ``inferences``: id, produces, premises, steps, assumptions,
    primary_explanation, alternatives (struct with distinguishing_evidence),
    falsify, strengthen, uncertainty. ``backed``: id, evidence_backed.
    """
    g = "reasoning"
    c = F.col
    premises = inferences.select("id", F.explode("premises").alias("p")).select("id", "p.ref", "p.role")
    support = premises.filter("role = 'supports'")
    broken = support.join(backed.filter("evidence_backed").select(c("id").alias("ref")), "ref", "left_anti")
    roles = F.transform("premises", lambda p: p["role"])
    vague = F.exists("alternatives", lambda a: F.coalesce(a["distinguishing_evidence"] == "", F.lit(True)))
    return union_all([
        check_present(must_have.select("id"), g, "NO_INFERENCE", "id", inferences, "produces"), check_unique(inferences, g, "DUPLICATE_INFERENCE", ["id"]),
        check_ref(inferences, g, "UNKNOWN_PRODUCT", "id", "produces", known), check_ref(premises, g, "UNKNOWN_PREMISE", "id", "ref", known),
        _as_findings(premises.join(superseded.select(c("id").alias("ref")), "ref", "left_semi"), g, "SUPERSEDED_PREMISE", "id"),
        check_rows(premises, g, "id", [("INVALID_ROLE", "error", ~c("role").isin("supports", "contradicts", "contextualizes"))]), _as_findings(broken, g, "BROKEN_CHAIN", "id"),
        check_refs(inferences, g, "UNKNOWN_ASSUMPTION", "id", "assumptions", assumptions),
        check_rows(inferences, g, "id", [
            ("NO_PREMISES", "error", _empty("premises")), ("NO_SUPPORT", "error", ~F.coalesce(F.array_contains(roles, "supports"), F.lit(False))), ("NO_STEPS", "error", _empty("steps")),
            ("NO_ASSUMPTIONS", "error", _empty("assumptions")), ("NO_EXPLANATION", "error", _blank("primary_explanation")), ("NO_ALTERNATIVES", "error", _empty("alternatives")),
            ("ALTERNATIVE_WITHOUT_EVIDENCE", "error", vague), ("NO_COUNTERFACTUALS", "error", _empty("falsify") & _empty("strengthen")), ("NO_UNCERTAINTY", "error", _empty("uncertainty"))])])


def findings_and_graph(findings: DataFrame, inferences: DataFrame, conflicts: DataFrame, cons: DataFrame, claims: DataFrame, known: DataFrame, superseded: DataFrame, backed: DataFrame,
                       anchored: DataFrame, method: DataFrame, nodes: DataFrame, graph_edges: DataFrame, why: DataFrame) -> DataFrame:
    """``anchored``: claim_id named in prose. ``method``: field, value. ``why``: node."""
    g = "reasoning graph"
    c = F.col
    supports = findings.select("id", F.explode("supports").alias("p")).select("id", "p.ref")
    ok = supports.join(backed.filter("evidence_backed").select(c("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    loose = supports.filter(c("ref").startswith("CLM-")).join(anchored.select(c("claim_id").alias("ref")), "ref", "left_anti")
    sides = conflicts.select("id", F.concat("side_a", "side_b").alias("refs"))
    covered = nodes.filter("kind IN ('executive_finding', 'claim', 'assessment')")
    return union_all([
        check_rows(findings, g, "id", [("FINDING_NO_SUPPORT", "error", _empty("supports")), ("FINDING_NO_UNCERTAINTY", "error", c("uncertainty").isNull())]),
        check_ref(supports, g, "FINDING_UNKNOWN_SUPPORT", "id", "ref", known), _as_findings(supports.join(superseded.select(c("id").alias("ref")), "ref", "left_semi"), g, "FINDING_ON_SUPERSEDED", "id"),
        _as_findings(loose, g, "FINDING_NOT_ANCHORED", "id"), check_present(findings.select("id"), g, "FINDING_NOT_BACKED", "id", ok, "id"),
        check_ref(findings, g, "FINDING_UNKNOWN_REASONING", "id", "reasoning", inferences), check_present(cons.select("id"), g, "SILENT_CONFLICT", "id", conflicts, "id"),
        check_refs(sides, g, "CONFLICT_UNKNOWN_SIDE", "id", "refs", known),
        check_rows(conflicts, g, "id", [("CONFLICT_NO_RESOLUTION", "error", _blank("resolution_state")), ("CONFLICT_NO_UNCERTAINTY", "error", c("remaining_uncertainty").isNull())]),
        check_rows(method, g, "field", [("METHOD_FIELD_MISSING", "error", _blank("value"))]),
        check_ref(graph_edges, g, "DANGLING_EDGE", "from", "from", nodes), check_ref(graph_edges, g, "DANGLING_EDGE", "to", "to", nodes),
        check_rows(graph_edges, g, "from", [("EDGE_WITHOUT_ORIGIN", "error", _blank("via"))]), check_present(covered.select("id"), g, "WHY_INDEX_MISSING", "id", why.select("node").distinct(), "node")])


def monitoring(published: DataFrame, told: DataFrame, truth: DataFrame, executions: DataFrame, note: str | None, cap: int = K.MAX_PROVIDER_CALLS) -> DataFrame:
    """Published monitoring tables. ``told`` and ``truth``: measure, value."""
    g = "monitoring"
    drift = told.select("measure", F.col("value").alias("_told")).join(truth, "measure", "left").filter(~F.col("_told").eqNullSafe(F.col("value")))
    over = executions.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap)
    found = [
        check_rows(published, g, "id", [("LEAKED_CANDIDATE", "error", ~F.coalesce(F.col("gate_status").isin(K.PUBLISHABLE), F.lit(False)))]),
        _as_findings(drift, g, "COUNT_MISMATCH", "measure"), _as_findings(over, g, "CALL_CAP_EXCEEDED", "run_id")]
    if not note:
        found.append(_as_findings(_one_row(told, "note"), g, "NO_NOTE", "_id"))
    return union_all(found)


# Type tokens of record shapes and their variant type names.
SHAPE_TYPES = {"string": ["STRING"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def record_shape(records: DataFrame, shape: dict[str, str], key: str = "id", body: str = "json") -> DataFrame:
    """Required keys and types of JSON records; ``?`` allows null, any allows all."""
    v = F.try_parse_json(body)
    checks = [("NOT_A_RECORD", "error", v.isNull())]
    for name, token in shape.items():
        value = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        absent = v.isNotNull() & value.isNull()
        null = F.is_variant_null(value)
        checks.append((f"MISSING {name}", "error", absent))
        base = token.rstrip("?")
        if not token.endswith("?") and base != "any":
            checks.append((f"NULL {name}", "error", null))
        if base != "any":
            fits = F.lit(False)
            for t in SHAPE_TYPES[base]:
                fits = fits | kind.startswith(t)
            checks.append((f"TYPE {name}", "error", value.isNotNull() & ~null & ~fits))
    return check_rows(records, "shape", key, checks)
