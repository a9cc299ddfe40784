"""Evidence: provider runs, artifacts, citations and the link chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions.text import collapse, first_match
from attestra.operators.extract import union_all
from attestra.operators.refs import latest_per_key


def availability_status(outcome: Column) -> Column:
    return (
        F.when(outcome == "ok", "AVAILABLE")
        .when(outcome.isin("provider_error", "blocked_terms"), "BLOCKED")
        .when(outcome == "http_error", "INVALID")
        .otherwise("UNKNOWN")
    )


def availability(runs: DataFrame) -> DataFrame:
    """State of each URL by its latest run."""
    last = latest_per_key(runs.select("url", "source_id", "finished_at", "run_id", "outcome", "http_status"), ["url"], ["finished_at", "run_id"])
    return last.select("url", "source_id", F.col("finished_at").alias("last_checked"), "http_status", "outcome",
                       availability_status(F.col("outcome")).alias("status"))


def attach_virtual_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Successful runs whose bytes were never stored become hash-only artifacts."""
    ok = runs.filter((F.col("outcome") == "ok") & F.col("sha256").isNotNull())
    # the earliest such run stands for its tag and entity
    first = ok.groupBy("tag", "entity").agg(F.min_by(F.struct("sha256", "url", "finished_at", "run_id", "source_id"),
                                                     F.struct("finished_at", "run_id")).alias("r"))
    missing = first.join(artifacts.select("tag", "entity"), ["tag", "entity"], "left_anti")
    virtual = missing.select("tag", "entity", "r.sha256", F.lit(None).cast("string").alias("storage_path"),
                             F.col("r.source_id").alias("source_id"), F.lit("METADATA_ONLY").alias("pub_class"), F.lit(True).alias("virtual"))
    return union_all([artifacts.select("tag", "entity", "sha256", "storage_path", "source_id", "pub_class", F.lit(False).alias("virtual")), virtual]).withColumn(
        "artifact_id", F.concat(F.lit("ART-"), F.substring("sha256", 1, 12)))


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Stored artifacts whose file is missing or has another hash.

    ``files``: path, content (bytes). Only the digest takes part in the join.
    """
    hashed = files.select(F.col("path").alias("storage_path"), F.sha2("content", 256).alias("file_sha256"))
    joined = manifest.filter(F.col("storage_path").isNotNull()).join(hashed, "storage_path", "left")
    rule = F.when(F.col("file_sha256").isNull(), "ARTIFACT_FILE_MISSING").when(
        F.col("file_sha256") != F.col("sha256"), "ARTIFACT_HASH_MISMATCH")
    return joined.select("artifact_id", "storage_path", rule.alias("rule")).filter("rule IS NOT NULL")


# File extension per media type.
EXTENSIONS = [("pdf", "pdf"), ("html", "html"), ("json", "json"), ("xml", "xml"), ("text", "plain")]


def publication_split(artifacts: DataFrame, base: str) -> DataFrame:
    """Public path, or no download and the reason why."""
    suffix = first_match(F.col("mime"), EXTENSIONS, F.lit("bin"))
    restricted = F.col("pub_class").startswith("RESTRICTED")
    virtual = F.col("storage_path").isNull()
    download = F.when(~restricted & ~virtual, F.concat(F.lit(base), F.col("sha256"), F.lit("."), suffix))
    reason = F.when(restricted, F.concat(F.lit("restricted: "), F.col("pub_class"))).when(virtual, F.lit("hash only, no stored body"))
    return artifacts.select("artifact_id", "sha256", "pub_class", download.alias("download"), reason.alias("reason"))


def redact_public(assertions: DataFrame) -> DataFrame:
    """Column allow-list; birth dates shrink to the year, local paths go."""
    title = F.regexp_replace("title", "(/Users|/home)/\\S*", "")
    return assertions.select("id", "entity", "predicate", "value", "who_name", F.substring("who_born", 1, 4).alias("born_year"),
                             collapse(title).alias("title"))


def text_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """1-based numbered lines of a text column."""
    rows = docs.select(key, F.posexplode(F.split(body, "\n")).alias("_p", "text"))
    return rows.select(key, (F.col("_p") + 1).alias("line"), "text")


#: Bytes of text, and rows that cite it, that one task of a join of both sorts.
BYTES_PER_TASK = 16 << 20
ROWS_PER_TASK = 100_000


def _beside_texts(citing: DataFrame, texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Both sides in as many partitions by ``key`` as their bytes and rows ask for.

    Left to Spark, a task sorts the texts that compress to its share, which grows
    with the table.
    """
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // BYTES_PER_TASK), -(-citing.count() // ROWS_PER_TASK))
    return citing.repartition(parts, key), texts.repartition(parts, key)


def verify_citations(spans: DataFrame, docs: DataFrame, window: int = 3) -> DataFrame:
    """Does the quoted text stand at its stated line, or within ``window``?

    Spans meet their document by key; the lines near the stated one are sliced
    from the document, so no line table is shuffled.
    """
    spans, docs = _beside_texts(spans, docs.select("file", "body"), "file", "body")
    rows = spans.join(docs, "file", "left").withColumn("lines", F.split("body", "\n"))
    want = collapse(F.col("exact_text"))
    n = F.col("line")
    at = collapse(F.coalesce(F.try_element_at("lines", F.greatest(n, F.lit(1)).cast("int")), F.lit("")))
    exact = at.contains(want) | (want.contains(at) & (F.length(at) > 10))
    start = F.greatest(n - window, F.lit(1))
    near = F.slice("lines", start.cast("int"), (n + window - start + 1).cast("int"))
    close = F.exists(near, lambda line: collapse(line).contains(want))
    how = (
        F.when(F.col("lines").isNull(), "file missing")
        .when(exact, "exact")
        .when(close, "window")
        .otherwise("not found")
    )
    return rows.select("id", "file", "line", how.alias("match"), how.isin("exact", "window").alias("verified"))


def verify_quotes(web_spans: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every quoted substring must occur verbatim in the preserved body."""
    web_spans, bodies = _beside_texts(web_spans, bodies, "artifact_tag", "body")
    rows = web_spans.join(bodies, "artifact_tag", "left")
    missing = F.filter("contains", lambda q: ~F.coalesce(F.col("body").contains(q), F.lit(False)))
    return rows.select("id", "artifact_tag", F.size("contains").alias("quotes"), F.size(missing).alias("missing"),
                       (F.col("body").isNotNull() & (F.size(missing) == 0)).alias("verified"))


def selector_bridge(selectors: DataFrame) -> DataFrame:
    """(selector_id, entity, predicate): what each selector asks for, each once.

    With the assertions by (entity, predicate) it says which assertions a
    selector selects, in as many rows as selectors and assertions have, also
    where many selectors ask for what many assertions state.
    """
    return selectors.select(F.col("id").alias("selector_id"), "entity", F.explode(F.array_distinct("predicates")).alias("predicate")).distinct()


def selector_counts(selectors: DataFrame, assertions: DataFrame) -> DataFrame:
    """(selector_id, matches): how many assertions each selector selects, 0 where none matched.

    Assertions are counted by (entity, predicate) first, so no pair is formed.
    """
    stated = assertions.groupBy("entity", "predicate").agg(F.count(F.lit(1)).alias("_n"))
    found = selector_bridge(selectors).join(stated, ["entity", "predicate"]).groupBy("selector_id").agg(F.sum("_n").alias("matches"))
    every = selectors.select(F.col("id").alias("selector_id")).distinct()
    return every.join(found, "selector_id", "left").select("selector_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def resolve_selectors(selectors: DataFrame, assertions: DataFrame) -> DataFrame:
    """(selector, assertion) rows; the assertion is null where none matched.

    Spells out every pair. For checks and look-ups ``selector_counts`` and the
    bridge are enough; pass only the selectors whose pairs are asked for.
    """
    wanted = selector_bridge(selectors)
    hits = wanted.join(assertions.select("entity", "predicate", F.col("id").alias("assertion_id")), ["entity", "predicate"])
    hits = hits.select("selector_id", "assertion_id")
    empty = selectors.select(F.col("id").alias("selector_id")).join(hits, "selector_id", "left_anti")
    return hits.unionByName(empty.withColumn("assertion_id", F.lit(None).cast("string")))


# Reference columns of an evidence link and the id space of each.
LINK_REFS = [("sourceId", "source"), ("spanId", "span"), ("webSpanId", "web_span"), ("selector", "selector"), ("artifactTag", "artifact")]


def resolve_links(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per reference of each link with what it resolves to.

    All references meet one dictionary (space, id) in a single join, instead of
    one join per reference kind.
    """
    refs = F.array(F.struct(F.lit("claim").alias("space"), F.col("claim_id").alias("id")),
                   *[F.struct(F.lit(space).alias("space"), F.col(c).alias("id")) for c, space in LINK_REFS])
    long = links.select("claim_id", "link_no", F.explode(F.filter(refs, lambda r: r["id"].isNotNull())).alias("r"))
    long = long.select("claim_id", "link_no", "r.space", "r.id")
    joined = long.join(dictionary.withColumn("_known", F.lit(True)), ["space", "id"], "left")
    return joined.select("claim_id", "link_no", "space", "id", F.coalesce("_known", F.lit(False)).alias("resolved"))


def evidence_inventory(claims: DataFrame, links: DataFrame, primary: DataFrame, families: DataFrame) -> DataFrame:
    """What kind of evidence each live claim really has.

    ``links``: claim_id, source_id, span_id, web_span_id, has_assertions,
    artifact_id. ``primary``: source_id of primary sources.
    """
    live = claims.filter("NOT superseded").select(F.col("id").alias("claim_id"), "status", "sources")
    cited = live.select("claim_id", F.explode("sources").alias("source_id")).unionByName(
        links.filter("source_id IS NOT NULL").select("claim_id", "source_id")).distinct()
    marked = cited.join(families, "source_id", "left").join(primary.select("source_id", F.lit(1).alias("_primary")), "source_id", "left")
    per_source = marked.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("sources"), F.countDistinct(F.coalesce("family_id", "source_id")).alias("independent_families"),
        F.count("_primary").alias("primary_sources"))
    exact = F.col("span_id").isNotNull() | F.col("web_span_id").isNotNull() | F.col("has_assertions")
    stored = F.col("artifact_id").isNotNull() | F.col("has_assertions") | F.col("span_id").isNotNull()
    per_link = links.groupBy("claim_id").agg(F.bool_or(exact).alias("exact_citation"), F.bool_or(stored).alias("artifact_preserved"))
    rows = live.drop("sources").join(per_source, "claim_id", "left").join(per_link, "claim_id", "left")
    rows = rows.na.fill(0, ["sources", "independent_families", "primary_sources"]).na.fill(False, ["exact_citation", "artifact_preserved"])
    strong = (F.col("primary_sources") > 0) | (F.col("status") == "SELF_REPORTED")
    category = (
        F.when(F.col("status") == "BLOCKED", "BLOCKED")
        .when(F.col("exact_citation") & F.col("artifact_preserved") & strong, "COMPLETE")
        .when(F.col("artifact_preserved"), "PARTIAL")
        .otherwise("REFERENCE_ONLY")
    )
    kind = F.when(F.col("status") == "ASSESSED", "assessment").otherwise("observation")
    return rows.select("claim_id", "status", category.alias("category"), "sources", "independent_families", "primary_sources",
                       "exact_citation", "artifact_preserved", kind.alias("kind"))


def evidence_items(inventory: DataFrame, links: DataFrame) -> DataFrame:
    """One nested record per claim; the list holds that claim's own links."""
    own = links.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("link_no", "source_id", "span_id", "web_span_id", "artifact_id"))).alias("links"))
    return inventory.join(own, "claim_id", "left")


def evidence_item_rows(inventory: DataFrame, links: DataFrame) -> DataFrame:
    """The same as rows: one per link of a claim, one without link for a claim that has none.

    For claims with any number of links: nothing is collected per claim, and the
    larger side stays where a skew join puts it.
    """
    return inventory.join(links.select("claim_id", "link_no", "source_id", "span_id", "web_span_id", "artifact_id"), "claim_id", "left")


def evidence_item(inventory: DataFrame, links: DataFrame, claim_id: str) -> DataFrame:
    """The nested record of one claim that is opened."""
    own = F.col("claim_id") == claim_id
    return evidence_items(inventory.filter(own), links.filter(own))


def provider_state(runs: DataFrame) -> DataFrame:
    """Per source: attempts and the state decided by the most recent one."""
    ok = F.col("outcome") == "ok"
    failure = F.when(F.col("http_status") >= 500, "PROVIDER_ERROR").otherwise("BLOCKED")
    grouped = runs.filter("source_id IS NOT NULL").groupBy("source_id").agg(
        F.max("finished_at").alias("last_attempt"),
        F.max(F.when(ok, F.col("finished_at"))).alias("last_success"),
        F.max(F.when(~ok, F.col("finished_at"))).alias("last_failure"),
        F.count_if(~ok).alias("failed_attempts"),
        F.max_by(F.when(~ok, failure), F.when(~ok, F.struct("finished_at", "run_id"))).alias("_fail_state"))
    down = F.col("last_failure").isNotNull() & F.coalesce(F.col("last_failure") > F.col("last_success"), F.lit(True))
    state = F.when(down, F.col("_fail_state")).when(F.col("last_success").isNotNull(), "AVAILABLE").otherwise("UNKNOWN")
    return grouped.withColumn("state", state).drop("_fail_state")


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Runs since the last success of each source.

    Counted against the time of the last success, so no source's runs are
    brought together in one task.
    """
    good = runs.filter("outcome = 'ok'").groupBy("source_id").agg(F.max("finished_at").alias("last_ok"))
    late = runs.join(good, "source_id", "left").filter("last_ok IS NULL OR finished_at > last_ok")
    counted = late.groupBy("source_id").agg(F.count(F.lit(1)).alias("failure_count"))
    every = runs.select("source_id").distinct()
    return every.join(counted, "source_id", "left").select("source_id", F.coalesce("failure_count", F.lit(0)).alias("failure_count"))


def publishable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(rules.PUBLISHABLE))
