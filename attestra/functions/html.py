"""Page metadata from HTML text as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import rules

# The entities pages use, the ampersand last.
ENTITIES = [("&#x2F;", "/"), ("&#x2f;", "/"), ("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]

# Where each metadata field stands in the markup.
META_PATTERNS = {
    "title": "<title>([\\s\\S]*?)</title>",
    "description": '<meta name="description" content="([^"]*)"',
    "canonical": '<link rel="canonical" href="([^"]*)"',
    "robots": '<meta name="robots" content="([^"]*)"',
    "og_title": '<meta property="og:title" content="([^"]*)"',
    "og_description": '<meta property="og:description" content="([^"]*)"',
    "og_image": '<meta property="og:image" content="([^"]*)"',
    "og_url": '<meta property="og:url" content="([^"]*)"',
    "twitter_card": '<meta name="twitter:card" content="([^"]*)"',
}
LINK = '<a\\b[^>]*\\bhref="([^"]+)"'
ASSET = '<(?:link|script|img)\\b[^>]*\\b(?:href|src)="([^"]+)"'
JSON_LD = '<script type="application/ld\\+json">([\\s\\S]*?)</script>'


def decode_entities(text: Column) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def _attribute(html: Column, pattern: str) -> Column:
    return F.when(html.rlike(pattern), F.trim(decode_entities(F.regexp_extract(html, pattern, 1))))


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def extract_page_meta(html: Column) -> list[Column]:
    """Metadata columns of a page: fields, heading count, links, assets, JSON-LD."""
    fields = [_attribute(html, p).alias(n) for n, p in META_PATTERNS.items()]
    return [
        *fields,
        F.size(F.regexp_extract_all(html, F.lit("<h1\\b"), F.lit(0))).alias("h1_count"),
        F.transform(_all(html, LINK), decode_entities).alias("links"),
        F.transform(_all(html, ASSET), decode_entities).alias("assets"),
        _all(html, JSON_LD).alias("jsonld"),
    ]


def is_indexable(robots: Column) -> Column:
    return F.coalesce((robots != "") & ~robots.rlike("(?i)noindex"), F.lit(False))


def route_for(path: Column) -> Column:
    """Route of a built file, or null when the file is not a route."""
    return F.when(path == "index.html", "/").when(path.endswith("/index.html"), F.concat(F.lit("/"), F.regexp_replace(path, "index\\.html$", "")))


def canonical_url(base: Column, route: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), route)


def url_to_path(base: Column, url: Column) -> Column:
    """File behind a same-site URL; null for other sites."""
    root = F.regexp_replace(base, "/+$", "")
    inside = url.startswith(F.concat(root, F.lit("/"))) | (url == root)
    rest = F.regexp_replace(F.substr(url, F.length(root) + 1), "[#?].*$", "")
    rest = F.regexp_replace(rest, "^/", "")
    path = F.when(rest == "", "index.html").when(rest.endswith("/"), F.concat(rest, F.lit("index.html"))).otherwise(rest)
    return F.when(inside, path)


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + rules.PLACEHOLDER), F.lit(False))
