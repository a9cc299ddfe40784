"""Audit of a corpus of rendered pages. Findings are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import rules
from attestra.functions import html as H
from attestra.functions.time import date_issue
from attestra.operators.extract import union_all
from attestra.session import cut_lineage

OG_FIELDS = [("og:title", "og_title"), ("og:description", "og_description"), ("og:image", "og_image"), ("og:url", "og_url"), ("twitter:card", "twitter_card")]
EVIDENCE_DATES = ["datePublished", "dateModified", "temporalCoverage"]


def page_table(pages: DataFrame) -> DataFrame:
    """Pages with metadata. ``pages``: site (base URL), path, html.

    The metadata struct comes out of a generator, so that every HTML text is
    matched once, however many rules and filters read the result.
    """
    leak = F.coalesce(F.col("html").rlike("(?i)" + rules.NON_PRODUCTION_HOSTS), F.lit(False)).alias("host_leak")
    once = F.explode(F.array(F.struct(*H.extract_page_meta(F.col("html")), leak)))
    rows = pages.select("site", "path", once.alias("m")).select("site", "path", "m.*")
    rows = rows.withColumn("route", H.route_for(F.col("path"))).withColumn("indexable", H.is_indexable(F.col("robots")))
    return rows.withColumn("expected_url", H.canonical_url(F.col("site"), F.col("route")))


def audit_findings(pages: DataFrame, files: DataFrame, today: str, root_relative: bool = False) -> tuple[DataFrame, DataFrame]:
    """(metadata, findings of all page rules).

    Metadata is far smaller than the pages and read by five rule groups, so it
    is written once to the reliable checkpoint folder.
    """
    meta = cut_lineage(page_table(pages))
    found = union_all([
        page_findings(meta), jsonld_findings(meta, today), link_findings(meta, files, root_relative),
        cross_page_duplicates(meta, "title", "E_DUP_TITLE"), cross_page_duplicates(meta, "description", "E_DUP_DESC"), orphan_findings(meta, root_relative)])
    return meta, found.select("site", "path", "rule")


def _finding(rule: str, cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(rule))


def _findings(df: DataFrame, checks: list[Column], keys: tuple[str, ...] = ("site", "path")) -> DataFrame:
    """One row per failed check of each row; one pass for all checks."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("rule"))


def page_findings(meta: DataFrame) -> DataFrame:
    """Title, description, heading, canonical, social and host rules."""
    c = F.col
    has = lambda n: F.coalesce(c(n) != "", F.lit(False))
    idx = c("indexable")
    route = c("route").isNotNull()
    social = [_finding("W_OG_MISSING " + label, idx & ~has(col)) for label, col in OG_FIELDS]
    checks = [
        _finding("E_TITLE_MISSING", ~has("title")),
        _finding("E_PLACEHOLDER title", H.has_placeholder(c("title"))),
        _finding("W_TITLE_LONG", F.length("title") > rules.TITLE_MAX),
        _finding("E_DESC_MISSING", idx & ~has("description")),
        _finding("E_PLACEHOLDER description", idx & H.has_placeholder(c("description"))),
        _finding("W_DESC_LONG", idx & (F.length("description") > rules.DESCRIPTION_MAX)),
        _finding("W_DESC_SHORT", idx & has("description") & (F.length("description") < rules.DESCRIPTION_MIN)),
        _finding("E_H1_COUNT", idx & (c("h1_count") != 1)),
        _finding("E_CANONICAL_MISSING", route & ~has("canonical")),
        _finding("E_CANONICAL_MISMATCH", route & has("canonical") & (c("canonical") != c("expected_url"))),
        _finding("E_CANONICAL_ON_NONROUTE", ~route & has("canonical")),
        *social,
        _finding("E_OG_URL_MISMATCH", idx & route & has("og_url") & (c("og_url") != c("expected_url"))),
        _finding("E_HOST_LEAK", c("host_leak")),
        _finding("W_JSONLD_MISSING", idx & (F.size("jsonld") == 0)),
    ]
    return _findings(meta, checks)


def jsonld_findings(meta: DataFrame, today: str) -> DataFrame:
    """Structured data: parses, context, type, URL and evidence dates."""
    blocks = meta.select("site", "path", "route", "expected_url", F.explode("jsonld").alias("raw"))
    rows = blocks.withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    get = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    rows = rows.select("site", "path", "route", "expected_url", F.col("v").isNull().alias("broken"), F.try_variant_get("v", "$['@context']", "string").alias("context"),
                       F.try_variant_get("v", "$['@type']", "string").alias("type"), get("url").alias("url"), *[get(d).alias(d) for d in EVIDENCE_DATES])
    c = F.col
    ok = ~c("broken")
    evidence = ok & c("type").isin(rules.EVIDENCE_TYPES)
    has = lambda n: F.coalesce(c(n) != "", F.lit(False))
    both = evidence & has("datePublished") & has("dateModified")
    day = lambda n: F.try_to_date(F.substring(c(n), 1, 10), "yyyy-MM-dd")
    checks = [
        _finding("E_JSONLD_INVALID", c("broken")),
        _finding("E_JSONLD_CONTEXT", ok & ~c("context").eqNullSafe(F.lit("https://schema.org"))),
        _finding("E_JSONLD_TYPE", ok & ~F.coalesce(c("type").isin(rules.SCHEMA_TYPES), F.lit(False))),
        _finding("E_JSONLD_URL_MISMATCH", ok & c("route").isNotNull() & has("url") & (c("url") != c("expected_url"))),
        *[_finding("E_EVIDENCE_MISSING " + d, evidence & ~has(d)) for d in EVIDENCE_DATES],
        *[_finding("E_DATE_INVALID " + d, both & has(d) & date_issue(c(d), F.lit(today)).isNotNull()) for d in EVIDENCE_DATES],
        _finding("E_DATE_ORDER modified", both & (day("dateModified") < day("datePublished"))),
        _finding("E_DATE_ORDER coverage", both & has("temporalCoverage") & (day("temporalCoverage") > day("dateModified"))),
    ]
    return _findings(rows, checks)


def link_targets(meta: DataFrame, root_relative: bool = False) -> DataFrame:
    """(site, path, href, target) of links; the target is null off the site.

    Links such as ``/x`` count as foreign unless ``root_relative`` places them
    on the page's own site.
    """
    rows = meta.select("site", "path", F.explode("links").alias("href"))
    rows = rows.filter(~F.col("href").rlike("^(mailto:|tel:|#)"))
    url = F.col("href")
    if root_relative:
        url = F.when(url.startswith("/") & ~url.startswith("//"), F.concat("site", url)).otherwise(url)
    return rows.withColumn("target", H.url_to_path(F.col("site"), url))


def link_findings(meta: DataFrame, files: DataFrame, root_relative: bool = False) -> DataFrame:
    """Script links, and links or assets whose file does not exist.

    Distinct targets meet the file list, so a link repeated on every page is
    looked up once per page at most. ``files``: site, path.
    """
    links = link_targets(meta, root_relative)
    script = links.filter(F.col("href").rlike("(?i)^javascript:")).select("site", "path", F.lit("E_LINK_JS_SCHEME").alias("rule"), F.col("href").alias("detail"))
    assets = meta.select("site", "path", "canonical", F.explode("assets").alias("href")).filter("canonical IS NULL OR href <> canonical")
    assets = assets.select("site", "path", "href", H.url_to_path(F.col("site"), F.col("href")).alias("target"))
    refs = links.select("site", "path", "href", "target", F.lit("E_LINK_BROKEN").alias("rule")).unionByName(assets.withColumn("rule", F.lit("E_ASSET_MISSING")))
    known = files.select("site", F.col("path").alias("target"))
    broken = refs.filter("target IS NOT NULL").join(known, ["site", "target"], "left_anti")
    return script.unionByName(broken.select("site", "path", "rule", F.col("href").alias("detail")))


def cross_page_duplicates(meta: DataFrame, field: str, rule: str) -> DataFrame:
    """Indexable pages that repeat the title or description of an earlier one.

    The first page of each value is found by an aggregate; the pages of a very
    common value are never sorted in one task.
    """
    rows = meta.filter(F.col("indexable") & F.col("route").isNotNull() & F.coalesce(F.col(field) != "", F.lit(False))).select("site", "path", F.col(field).alias("value"))
    first = rows.groupBy("value").agg(F.min(F.struct("site", "path")).alias("original"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    again = rows.join(first, "value").filter(F.struct("site", "path") != F.col("original"))
    return again.select("site", "path", F.lit(rule).alias("rule"), F.concat_ws(" ", "original.site", "original.path").alias("detail"))


def orphan_findings(meta: DataFrame, root_relative: bool = False) -> DataFrame:
    """Indexable routes that no page of their site links to."""
    linked = link_targets(meta, root_relative).filter("target IS NOT NULL").select("site", F.concat(F.lit("/"), F.regexp_replace("target", "index\\.html$", "")).alias("route")).distinct()
    pages = meta.filter(F.col("indexable") & F.col("route").isNotNull() & (F.col("route") != "/"))
    return pages.join(linked, ["site", "route"], "left_anti").select("site", "path", F.lit("W_ORPHAN").alias("rule"), F.col("route").alias("detail"))


def sitemap_findings(meta: DataFrame, files: DataFrame, sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """Sitemap and robots file against the pages.

    ``sitemaps``: site, xml (any number of files per site). ``robots``: site,
    txt. ``files``: site, path.
    """
    c = F.col
    sites = meta.select("site").distinct()
    row = lambda df, rule, detail: df.select("site", F.lit("sitemap.xml").alias("path"), F.lit(rule).alias("rule"), detail.alias("detail"))
    locs = sitemaps.select("site", F.explode(F.regexp_extract_all("xml", F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("loc"))
    counted = locs.groupBy("site", "loc").agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("string")
    missing = row(sites.join(sitemaps.select("site"), "site", "left_anti"), "E_SITEMAP_MISSING", null)
    twice = row(counted.filter("n > 1").select("site").distinct(), "E_SITEMAP_DUPLICATE", null)
    wanted = meta.filter(c("indexable") & c("route").isNotNull()).select("site", "expected_url").join(sitemaps.select("site"), "site", "left_semi")
    absent = row(wanted.join(counted.select("site", c("loc").alias("expected_url")), ["site", "expected_url"], "left_anti"), "E_SITEMAP_MISSING_URL", c("expected_url"))
    placed = counted.withColumn("target", H.url_to_path(c("site"), c("loc")))
    foreign = row(placed.filter("target IS NULL"), "E_SITEMAP_EXTERNAL", c("loc"))
    inside = placed.filter("target IS NOT NULL")
    known = files.select("site", c("path").alias("target"))
    gone = row(inside.join(known, ["site", "target"], "left_anti"), "E_SITEMAP_404", c("loc"))
    hidden = meta.filter(~c("indexable")).select("site", c("path").alias("target"))
    noindex = row(inside.join(known, ["site", "target"], "left_semi").join(hidden, ["site", "target"], "left_semi"), "E_SITEMAP_NOINDEX", c("loc"))
    pointer = sites.join(robots, "site", "left")
    rule = F.when(c("txt").isNull(), "E_ROBOTS_MISSING").when(~c("txt").contains(H.canonical_url(c("site"), F.lit("/sitemap.xml"))), "E_ROBOTS_SITEMAP")
    robot = pointer.select("site", F.lit("robots.txt").alias("path"), rule.alias("rule"), null.alias("detail")).filter("rule IS NOT NULL")
    return union_all([missing, twice, absent, foreign, gone, noindex, robot])


def hardcoded_hosts(lines: DataFrame) -> DataFrame:
    """Template lines with a literal host in an attribute.

    ``lines``: site, path, line, text.
    """
    host = F.regexp_replace("site", "^https?://|/+$", "")
    attribute = F.col("text").rlike("(href|src|content|url)\\s*=\\s*[\"'][^\"']*")
    return lines.filter(attribute & F.col("text").contains(host)).select("site", "path", "line", F.lit("E_SOURCE_HARDCODED_HOST").alias("rule"))


def review_policy_findings(docs: DataFrame, today: str) -> DataFrame:
    """Review policy of source documents.

    ``docs``: path, has_front_matter, seo_type, reviewed_at, cutoff,
    review_interval_days, confidence.
    """
    c = F.col
    present = c("has_front_matter")
    evidence = present & c("seo_type").isin(rules.EVIDENCE_TYPES)
    full = c("reviewed_at").isNotNull() & c("cutoff").isNotNull() & c("review_interval_days").isNotNull() & c("confidence").isNotNull()
    checked = evidence & full
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date("reviewed_at", "yyyy-MM-dd"))
    checks = [
        _finding("E_FRONTMATTER_MISSING", ~present),
        _finding("E_SEO_TYPE", present & c("seo_type").isNotNull() & ~c("seo_type").isin(rules.SCHEMA_TYPES)),
        _finding("E_REVIEW_POLICY_MISSING", evidence & ~full),
        _finding("E_CONFIDENCE", checked & ~c("confidence").isin("high", "moderate", "low")),
        *[_finding("E_DATE_INVALID " + d, checked & date_issue(c(d), F.lit(today)).isNotNull()) for d in ("reviewed_at", "cutoff")],
        _finding("W_REVIEW_OVERDUE", checked & (age > c("review_interval_days"))),
    ]
    return _findings(docs, checks, ("path",))


def level_of(rule: Column) -> Column:
    return F.when(rule.startswith("E_"), "error").otherwise("warn")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("site", "path", "rule")


def audit_summary(meta: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """Pages, indexable pages, errors, warnings, and whether the audit passes."""
    pages = meta.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("indexable") & F.col("route").isNotNull()).alias("indexable"))
    level = level_of(F.col("rule"))
    found = findings.agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warn").alias("warnings"))
    failed = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    # both sides are a single aggregated row
    return pages.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("ok", ~failed)
