"""Queries on the page corpus.

The test pages carry only a title and a heading, so every page gets further
head tags that depend on the page, right ones and wrong ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import html as H
from attestra.functions.time import date_issue
from attestra.operators import pages as P
from attestra.plans.inputs import cte, table, with_ctes
from attestra.plans.registry import query

TODAY = "2024-06-01"

SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"

# head tags by page number; the same text in both engines
EXTRA = """concat(
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<meta name="robots" content="noindex">' ELSE '<meta name="robots" content="index, follow">' END,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<meta name="description" content="', repeat('long text ', 20), '">') WHEN 2 THEN concat('<meta name="description" content="short ', page_id % 3, '">')
    WHEN 3 THEN '<meta name="description" content="TODO: write about this page, it has no words of its own yet">' ELSE concat('<meta name="description" content="A description of page number ', page_id, ' &amp; of everything that stands on it">') END,
  CASE page_id % 3 WHEN 0 THEN concat('<link rel="canonical" href="', site, coalesce(route, '/none'), '">') WHEN 1 THEN '<link rel="canonical" href="https://other.example/">' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:url" content="', site, CASE WHEN page_id % 8 = 0 THEN '/x/' ELSE coalesce(route, '') END, '">') ELSE '<meta name="twitter:card" content="summary">' END,
  CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '<script type="application/ld+json">{broken</script>' WHEN 2 THEN concat('<script type="application/ld+json">{"@context":"https://schema.org","@type":"WebPage","url":"', site, '/y/"}</script>')
    WHEN 3 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Report","datePublished":"2024-01-01","dateModified":"2024-02-01","temporalCoverage":"2024-03-01"}</script>'
    WHEN 4 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Report","datePublished":"2024-05-01"}</script>'
    ELSE '<script type="application/ld+json">{"@context":"https://other.org","@type":"Review"}</script><script type="application/ld+json">{"@context":"https://schema.org","@type":"Report","datePublished":"2025-01-01","dateModified":"2024-01-01"}</script>' END,
  CASE page_id % 7 WHEN 0 THEN '<a href="javascript:void(0)">x</a>' WHEN 1 THEN concat('<a class="k" href="', site, coalesce(route, '/'), '#top">self</a>') WHEN 2 THEN concat('<a href="', site, '/missing/">gone</a><img src="', site, '/logo.png">') WHEN 3 THEN '<a href="mailto:a@b.cz">m</a><a href="http://localhost:8000/">dev</a>' ELSE '' END)"""
PATH = """CASE WHEN p IN ('', '/') THEN 'index.html' WHEN p LIKE '%/' THEN concat(substring(p, 2), 'index.html') WHEN p LIKE '%.html' THEN substring(p, 2) ELSE concat(substring(p, 2), '/index.html') END"""
ROUTE = "CASE WHEN path = 'index.html' THEN '/' WHEN path LIKE '%/index.html' THEN concat('/', substring(path, 1, length(path) - 10)) END"


def pages(spark, sf):
    d = table(spark, sf, "pages").selectExpr("page_id", f"{SITE} AS site", "url", "html")
    d = d.selectExpr("*", "regexp_replace(substring(url, length(site) + 1), '[?#].*$', '') AS p").selectExpr("page_id", "site", "html", f"{PATH} AS path")
    return d.selectExpr("*", f"{ROUTE} AS route").selectExpr("page_id", "site", "path", f"replace(html, '</head>', concat({EXTRA}, '</head>')) AS html")


cte("pg", f"""SELECT page_id, site, path, route, replace(html, '</head>', concat({EXTRA}, '</head>')) AS html FROM (SELECT *, {ROUTE} AS route FROM (SELECT *, {PATH} AS path FROM
  (SELECT page_id, {SITE} AS site, html, regexp_replace(substring(url, length({SITE}) + 1), '[?#].*$', '') AS p FROM pages)))""")
DECODE = "replace(replace(replace(replace(replace(replace(replace({x}, '&#x2F;', '/'), '&#x2f;', '/'), '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _attr(name, pattern):
    return f"CASE WHEN regexp_matches(html, '{pattern}') THEN trim({DECODE.format(x=f'''regexp_extract(html, '{pattern}', 1)''')}) END AS {name}"


cte("meta", f"""SELECT site, path, route, concat(site, route) AS expected_url, {', '.join(_attr(n, p) for n, p in H.META_PATTERNS.items())}, len(regexp_extract_all(html, '<h1\\b')) AS h1,
  list_transform(regexp_extract_all(html, '{H.LINK}', 1), lambda x: {DECODE.format(x='x')}) AS links, list_transform(regexp_extract_all(html, '{H.ASSET}', 1), lambda x: {DECODE.format(x='x')}) AS assets, regexp_extract_all(html, '{H.JSON_LD}', 1) AS jsonld,
  regexp_matches(lower(html), '(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|:8000|staging\\.|\\.github\\.io)') AS leak FROM pg""", ["pg"])
cte("m", "SELECT *, coalesce(robots <> '' AND NOT regexp_matches(lower(robots), 'noindex'), false) AS idx FROM meta", ["meta"])
# Spark pages have no route column of their own; it comes from the path


def meta(spark, sf):
    return P.page_table(pages(spark, sf))


def files(spark, sf):
    return pages(spark, sf).select("site", "path").distinct()


@query("S5_pages", with_ctes("pg", "SELECT page_id, site, path, route, site || route AS canonical, length(html) AS n FROM pg"))
def _(spark, sf):
    p = pages(spark, sf)
    route = H.route_for(F.col("path"))
    return p.select("page_id", "site", "path", route.alias("route"), H.canonical_url(F.col("site"), route).alias("canonical"), F.length("html").cast("bigint").alias("n"))


@query("F35_extract_page_meta", with_ctes("m", """
SELECT site, path, title, description, canonical, robots, og_title, og_url, twitter_card, h1::BIGINT AS h1_count, array_to_string(links, ' ') AS links, array_to_string(assets, ' ') AS assets, len(jsonld)::BIGINT AS jsonld FROM m"""))
def _(spark, sf):
    return meta(spark, sf).select("site", "path", "title", "description", "canonical", "robots", "og_title", "og_url", "twitter_card", F.col("h1_count").cast("bigint").alias("h1_count"),
                                  F.array_join("links", " ").alias("links"), F.array_join("assets", " ").alias("assets"), F.size("jsonld").cast("bigint").alias("jsonld"))


@query("P13_indexable", with_ctes("m", "SELECT site, path FROM m WHERE idx"))
def _(spark, sf):
    return meta(spark, sf).filter("indexable").select("site", "path")


@query("F36_decode_entities", f"SELECT page_id, {DECODE.format(x='html')} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.decode_entities(F.col("html")).alias("text"))


@query("F34_url_to_path", with_ctes("m", """
, l AS (SELECT site, path, unnest(links) AS href FROM m)
SELECT site, path, href, CASE WHEN starts_with(href, site || '/') OR href = site THEN CASE WHEN r = '' THEN 'index.html' WHEN r LIKE '%/' THEN r || 'index.html' ELSE r END END AS target
FROM (SELECT *, regexp_replace(regexp_replace(substr(href, length(site) + 1), '[#?].*$', ''), '^/', '') AS r FROM l) WHERE NOT regexp_matches(href, '^(mailto:|tel:|#)')"""))
def _(spark, sf):
    return P.link_targets(meta(spark, sf))


def _rule(rule, cond):
    return f"CASE WHEN {cond} THEN '{rule}' END"


HAS = lambda n: f"coalesce({n} <> '', false)"
RULES = {
    "H1": [("E_TITLE_MISSING", f"NOT {HAS('title')}"), ("E_PLACEHOLDER title", "regexp_matches(lower(title), '\\b(todo|fixme|xxx|lorem ipsum|coming soon|placeholder)\\b')"), ("W_TITLE_LONG", "length(title) > 60"),
           ("E_DESC_MISSING", f"idx AND NOT {HAS('description')}"), ("E_PLACEHOLDER description", "idx AND regexp_matches(lower(description), '\\b(todo|fixme|xxx|lorem ipsum|coming soon|placeholder)\\b')"),
           ("W_DESC_LONG", "idx AND length(description) > 160"), ("W_DESC_SHORT", f"idx AND {HAS('description')} AND length(description) < 50"), ("E_H1_COUNT", "idx AND h1 <> 1")],
    "H2": [("E_CANONICAL_MISSING", f"route IS NOT NULL AND NOT {HAS('canonical')}"), ("E_CANONICAL_MISMATCH", f"route IS NOT NULL AND {HAS('canonical')} AND canonical <> expected_url"), ("E_CANONICAL_ON_NONROUTE", f"route IS NULL AND {HAS('canonical')}")],
    "H3": [*[("W_OG_MISSING " + l, f"idx AND NOT {HAS(c)}") for l, c in P.OG_FIELDS], ("E_OG_URL_MISMATCH", f"idx AND route IS NOT NULL AND {HAS('og_url')} AND og_url <> expected_url")],
    "H4": [("E_HOST_LEAK", "leak")],
    "H5": [("W_JSONLD_MISSING", "idx AND len(jsonld) = 0")],
}
ALL_RULES = [r for group in RULES.values() for r in group]
cte("page_findings", f"SELECT site, path, unnest(list_filter([{', '.join(_rule(*r) for r in ALL_RULES)}], lambda x: x IS NOT NULL)) AS rule FROM m", ["m"])


def _group(name, prefix):
    rules = sorted(r for r, _ in RULES[name])
    quoted = ", ".join(f"'{r}'" for r in rules)

    @query(f"{name}_{prefix}", with_ctes("page_findings", f"SELECT site, path, rule FROM page_findings WHERE rule IN ({quoted})"))
    def _(spark, sf):
        return P.page_findings(meta(spark, sf)).filter(F.col("rule").isin(rules))


for _name, _prefix in (("H1", "title_description"), ("H2", "canonical"), ("H3", "social"), ("H4", "host_hygiene"), ("H5", "jsonld_missing")):
    _group(_name, _prefix)


cte("blocks", """SELECT site, path, route, expected_url, raw, NOT json_valid(raw) AS broken, CASE WHEN json_valid(raw) THEN raw->>'$."@context"' END AS ctx, CASE WHEN json_valid(raw) THEN raw->>'$."@type"' END AS type, CASE WHEN json_valid(raw) THEN raw->>'$.url' END AS url,
  CASE WHEN json_valid(raw) THEN raw->>'$.datePublished' END AS dp, CASE WHEN json_valid(raw) THEN raw->>'$.dateModified' END AS dm, CASE WHEN json_valid(raw) THEN raw->>'$.temporalCoverage' END AS tc FROM (SELECT site, path, route, expected_url, unnest(jsonld) AS raw FROM m)""", ["m"])
LD = [("E_JSONLD_INVALID", "broken"), ("E_JSONLD_CONTEXT", "NOT broken AND ctx IS DISTINCT FROM 'https://schema.org'"), ("E_JSONLD_TYPE", "NOT broken AND coalesce(type NOT IN ('WebSite', 'WebPage', 'Report', 'Article', 'CollectionPage'), true)"),
      ("E_JSONLD_URL_MISMATCH", "NOT broken AND route IS NOT NULL AND url <> '' AND url <> expected_url")]
LD6 = [("E_EVIDENCE_MISSING datePublished", "type = 'Report' AND dp IS NULL"), ("E_EVIDENCE_MISSING dateModified", "type = 'Report' AND dm IS NULL"), ("E_EVIDENCE_MISSING temporalCoverage", "type = 'Report' AND tc IS NULL"),
       *[(f"E_DATE_INVALID {n}", f"type = 'Report' AND dp IS NOT NULL AND dm IS NOT NULL AND {c} IS NOT NULL AND (try_cast({c} AS DATE) IS NULL OR try_cast({c} AS DATE) > DATE '{TODAY}')") for n, c in (("datePublished", "dp"), ("dateModified", "dm"), ("temporalCoverage", "tc"))],
       ("E_DATE_ORDER modified", "type = 'Report' AND dm::DATE < dp::DATE"), ("E_DATE_ORDER coverage", "type = 'Report' AND dp IS NOT NULL AND tc::DATE > dm::DATE")]


@query("H5_jsonld", with_ctes("blocks", f"SELECT site, path, unnest(list_filter([{', '.join(_rule(*r) for r in LD)}], lambda x: x IS NOT NULL)) AS rule FROM blocks"))
def _(spark, sf):
    return P.jsonld_findings(meta(spark, sf), TODAY).filter(F.col("rule").startswith("E_JSONLD"))


@query("H6_evidence_dates", with_ctes("blocks", f"SELECT site, path, unnest(list_filter([{', '.join(_rule(*r) for r in LD6)}], lambda x: x IS NOT NULL)) AS rule FROM blocks"))
def _(spark, sf):
    return P.jsonld_findings(meta(spark, sf), TODAY).filter(~F.col("rule").startswith("E_JSONLD"))


cte("targets", """SELECT site, path, href, CASE WHEN starts_with(u, site || '/') OR u = site THEN CASE WHEN r = '' THEN 'index.html' WHEN r LIKE '%/' THEN r || 'index.html' ELSE r END END AS target, what
  FROM (SELECT *, regexp_replace(regexp_replace(substr(u, length(site) + 1), '[#?].*$', ''), '^/', '') AS r FROM (SELECT *, CASE WHEN what = 'link' AND starts_with(href, '/') AND NOT starts_with(href, '//') THEN site || href ELSE href END AS u FROM (
    SELECT site, path, unnest(links) AS href, 'link' AS what FROM m UNION ALL SELECT site, path, href, 'asset' FROM (SELECT site, path, canonical, unnest(assets) AS href FROM m) WHERE canonical IS NULL OR href <> canonical))) WHERE what = 'asset' OR NOT regexp_matches(href, '^(mailto:|tel:|#)')""", ["m"])


@query("H7_links_assets", with_ctes("targets pg", """
SELECT site, path, 'E_LINK_JS_SCHEME' AS rule, href AS detail FROM targets WHERE what = 'link' AND regexp_matches(href, '^javascript:')
UNION ALL SELECT site, path, CASE what WHEN 'link' THEN 'E_LINK_BROKEN' ELSE 'E_ASSET_MISSING' END, href FROM targets t WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.site = t.site AND pg.path = t.target)"""))
def _(spark, sf):
    return P.link_findings(meta(spark, sf), files(spark, sf), root_relative=True)


def _dup(field, rule):
    return f"""SELECT a.site, a.path, '{rule}' AS rule, f.s || ' ' || f.p AS detail FROM (SELECT site, path, {field} AS v FROM m WHERE idx AND route IS NOT NULL AND {field} <> '') a
      JOIN (SELECT v, o.site AS s, o.path AS p FROM (SELECT {field} AS v, min({{'site': site, 'path': path}}) AS o, count(*) AS n FROM m WHERE idx AND route IS NOT NULL AND {field} <> '' GROUP BY 1) WHERE n > 1) f ON f.v = a.v WHERE a.site <> f.s OR a.path <> f.p"""


DUPS = _dup("title", "E_DUP_TITLE") + " UNION ALL " + _dup("description", "E_DUP_DESC")


def duplicates(spark, sf):
    d = meta(spark, sf)
    return P.cross_page_duplicates(d, "title", "E_DUP_TITLE").unionByName(P.cross_page_duplicates(d, "description", "E_DUP_DESC"))


@query("H8_uniqueness", with_ctes("m", DUPS))
def _(spark, sf):
    return duplicates(spark, sf)


@query("A24_cross_page_duplicates", with_ctes("m", f"SELECT rule, count(*) AS n FROM ({DUPS}) GROUP BY rule"))
def _(spark, sf):
    return duplicates(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("H9_orphans", with_ctes("m targets", """
SELECT site, path, 'W_ORPHAN' AS rule, route AS detail FROM m WHERE idx AND route IS NOT NULL AND route <> '/' AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.what = 'link' AND t.site = m.site AND '/' || regexp_replace(t.target, 'index\\.html$', '') = m.route)"""))
def _(spark, sf):
    return P.orphan_findings(meta(spark, sf), root_relative=True)


def sitemaps(spark, sf):
    """Sitemap fragments of sites on https, with repeated, foreign and stale entries."""
    p = pages(spark, sf).filter("site LIKE 'https:%'")
    urls = p.selectExpr("site", "page_id", f"concat('<loc>', CASE WHEN page_id % 9 = 0 THEN 'https://other.example/' WHEN page_id % 9 = 1 THEN concat(site, '/old/') ELSE concat(site, '/', regexp_replace(path, 'index.html$', '')) END, '</loc>') AS loc")
    extra = urls.filter("page_id % 9 = 2")
    return urls.unionByName(extra).select("site", F.col("loc").alias("xml"))


cte("smap", """SELECT site, loc, count(*) AS n FROM (SELECT site, page_id, CASE WHEN page_id % 9 = 0 THEN 'https://other.example/' WHEN page_id % 9 = 1 THEN site || '/old/' ELSE site || '/' || regexp_replace(path, 'index.html$', '') END AS loc, unnest(CASE WHEN page_id % 9 = 2 THEN [1, 2] ELSE [1] END) AS k FROM pg WHERE site LIKE 'https:%') GROUP BY ALL""", ["pg"])
cte("placed", """SELECT *, CASE WHEN starts_with(loc, site || '/') THEN CASE WHEN r = '' THEN 'index.html' WHEN r LIKE '%/' THEN r || 'index.html' ELSE r END END AS target FROM (SELECT *, substr(loc, length(site) + 2) AS r FROM smap)""", ["smap"])


@query("H10_sitemap_robots", with_ctes("m placed pg", """
SELECT DISTINCT site, 'sitemap.xml' AS path, 'E_SITEMAP_MISSING' AS rule, NULL AS detail FROM pg WHERE site NOT LIKE 'https:%' UNION ALL SELECT DISTINCT site, 'sitemap.xml', 'E_SITEMAP_DUPLICATE', NULL FROM placed WHERE n > 1
UNION ALL SELECT site, 'sitemap.xml', 'E_SITEMAP_MISSING_URL', expected_url FROM m WHERE idx AND route IS NOT NULL AND site LIKE 'https:%' AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.site = m.site AND p.loc = m.expected_url)
UNION ALL SELECT site, 'sitemap.xml', 'E_SITEMAP_EXTERNAL', loc FROM placed WHERE target IS NULL UNION ALL SELECT site, 'sitemap.xml', 'E_SITEMAP_404', loc FROM placed p WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.site = p.site AND pg.path = p.target)
UNION ALL SELECT site, 'sitemap.xml', 'E_SITEMAP_NOINDEX', loc FROM placed p WHERE EXISTS (SELECT 1 FROM m WHERE m.site = p.site AND m.path = p.target AND NOT m.idx)
UNION ALL SELECT site, 'robots.txt', CASE WHEN contains(site, 'blog') THEN 'E_ROBOTS_MISSING' ELSE 'E_ROBOTS_SITEMAP' END, NULL FROM (SELECT DISTINCT site FROM pg) WHERE contains(site, 'blog') OR contains(site, '.org')"""))
def _(spark, sf):
    sites = files(spark, sf).select("site").distinct()
    robots = sites.filter("site NOT LIKE '%blog%'").selectExpr("site", "CASE WHEN site LIKE '%.org%' THEN 'User-agent: *' ELSE concat('Sitemap: ', site, '/sitemap.xml') END AS txt")
    return P.sitemap_findings(meta(spark, sf), files(spark, sf), sitemaps(spark, sf), robots)


def audit(spark, sf):
    return P.audit_findings(pages(spark, sf), files(spark, sf), TODAY, root_relative=True)


ALL = f"""SELECT site, path, rule FROM page_findings UNION ALL SELECT site, path, unnest(list_filter([{', '.join(_rule(*r) for r in LD + LD6)}], lambda x: x IS NOT NULL)) FROM blocks UNION ALL SELECT site, path, rule FROM ({DUPS})
  UNION ALL SELECT site, path, 'E_LINK_JS_SCHEME' FROM targets WHERE what = 'link' AND regexp_matches(href, '^javascript:')
  UNION ALL SELECT site, path, CASE what WHEN 'link' THEN 'E_LINK_BROKEN' ELSE 'E_ASSET_MISSING' END FROM targets t WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.site = t.site AND pg.path = t.target)
  UNION ALL SELECT site, path, 'W_ORPHAN' FROM m WHERE idx AND route IS NOT NULL AND route <> '/' AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.what = 'link' AND t.site = m.site AND '/' || regexp_replace(t.target, 'index\\.html$', '') = m.route)"""


@query("T7_sort_findings", with_ctes("page_findings blocks m targets pg", f"SELECT * FROM ({ALL}) ORDER BY site, path, rule"))
def _(spark, sf):
    return P.sort_findings(audit(spark, sf)[1])


@query("H11_audit_summary", with_ctes("page_findings blocks m targets pg", f"""
SELECT (SELECT count(*) FROM m) AS pages, (SELECT count(*) FROM m WHERE idx AND route IS NOT NULL) AS indexable, count(*) FILTER (starts_with(rule, 'E_')) AS errors, count(*) FILTER (starts_with(rule, 'W_')) AS warnings, false AS ok FROM ({ALL})"""))
def _(spark, sf):
    return P.audit_summary(*audit(spark, sf))


@query("H4_hardcoded_host", """
SELECT doc_id, line::BIGINT AS line, 'E_SOURCE_HARDCODED_HOST' AS rule FROM (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text || CASE WHEN lang = 'en' THEN chr(10) || '<a href="https://host.example/x">' ELSE chr(10) || 'see host.example' END, chr(10)) AS l FROM documents))
WHERE contains(text, 'host.example') AND regexp_matches(text, '(href|src|content|url)\\s*=\\s*["''][^"'']*')""")
def _(spark, sf):
    from attestra.operators.evidence import text_lines

    d = table(spark, sf, "documents").selectExpr("doc_id", "concat(text, CASE WHEN lang = 'en' THEN '\n<a href=\"https://host.example/x\">' ELSE '\nsee host.example' END) AS body")
    lines = text_lines(d, "doc_id", "body").withColumn("site", F.lit("https://host.example/")).withColumn("path", F.col("doc_id"))
    return P.hardcoded_hosts(lines).select(F.col("path").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "rule")


@query("F37_date_issues", """
SELECT doc_id, v, CASE WHEN try_cast(v AS DATE) IS NULL THEN 'invalid' WHEN try_cast(v AS DATE) > DATE '2024-06-01' THEN 'future' END AS issue FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 'soon' WHEN 'de' THEN '2031-01-01' ELSE '2023-05-05' END AS v FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "CASE lang WHEN 'fr' THEN 'soon' WHEN 'de' THEN '2031-01-01' ELSE '2023-05-05' END AS v")
    return d.select("doc_id", "v", date_issue(F.col("v"), F.lit(TODAY)).alias("issue"))


@query("Q21_review_policy", """
WITH d AS (SELECT 'doc/' || doc_id AS path, doc_id % 10 <> 0 AS fm, CASE doc_id % 4 WHEN 0 THEN 'Report' WHEN 1 THEN 'Review' WHEN 2 THEN 'Report' END AS t, CASE WHEN lang <> 'fr' THEN CASE WHEN lang = 'de' THEN '2025-01-01' ELSE '2024-01-01' END END AS rv, '2023-12-01' AS cutoff,
  n_chars % 200 AS days, CASE WHEN lang = 'es' THEN 'sure' ELSE 'high' END AS conf FROM documents)
SELECT path, unnest(list_filter([CASE WHEN NOT fm THEN 'E_FRONTMATTER_MISSING' END, CASE WHEN fm AND t = 'Review' THEN 'E_SEO_TYPE' END, CASE WHEN fm AND t = 'Report' AND rv IS NULL THEN 'E_REVIEW_POLICY_MISSING' END, CASE WHEN fm AND t = 'Report' AND rv IS NOT NULL AND conf = 'sure' THEN 'E_CONFIDENCE' END,
  CASE WHEN fm AND t = 'Report' AND rv > '2024-06-01' THEN 'E_DATE_INVALID reviewed_at' END, CASE WHEN fm AND t = 'Report' AND date_diff('day', rv::DATE, DATE '2024-06-01') > days THEN 'W_REVIEW_OVERDUE' END], lambda x: x IS NOT NULL)) AS rule FROM d""")
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        "concat('doc/', doc_id) AS path", "doc_id % 10 <> 0 AS has_front_matter", "CASE doc_id % 4 WHEN 0 THEN 'Report' WHEN 1 THEN 'Review' WHEN 2 THEN 'Report' END AS seo_type",
        "CASE WHEN lang <> 'fr' THEN CASE WHEN lang = 'de' THEN '2025-01-01' ELSE '2024-01-01' END END AS reviewed_at", "'2023-12-01' AS cutoff", "n_chars % 200 AS review_interval_days", "CASE WHEN lang = 'es' THEN 'sure' ELSE 'high' END AS confidence")
    return P.review_policy_findings(d, TODAY)
