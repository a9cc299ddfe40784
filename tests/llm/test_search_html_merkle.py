"""Lexical search, HTML extraction and the Merkle manifest against plain versions."""

import html as entities
import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import html, lexical, merkle
from tests.llm.brute import lower

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
CLASHES = ("part", "piece", "mark", "term", "times", "bit", "score", "rank", "tree", "pos", "size", "leaf", "root", "unit", "html_", "block", "item")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, queries, k=20):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(queries):
        rows = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = 0
            for t in TERM.findall(lower(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score:
                rows.append((-score, d is None, d))
        for r, (s, _, d) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, r, d, -s] += 1
    return out


def odd_corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["Émile", "Σ", "a_b", "x-y", "ÀB"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(300)]
    docs += [(5, "the w1 w2"), (5, "w3 w4"), (5, "w3 w4"), (None, "w3 w4"), (None, "w1"), (900, None), (901, ""), (902, " .,- "), (903, "the " * 30_000 + "needle"), (904, "NEEDLE\x00hay")]
    return docs


QUERIES = [(0, "w1 w2 w3 w3 the the"), (1, "needle in the hay"), (1, "w7"), (2, None), (3, ""), (4, "nothing known here"), (5, "ÀB émile Émile A_B"), (None, "w4 w5"), (6, "the"), (6, "the"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 7, "block_queries": 2}])
def test_search(spark, limits):
    docs = clashing(spark.createDataFrame(odd_corpus(), "doc_id long, text string")).repartition(3)
    items = clashing(spark.createDataFrame(QUERIES, "item_id long, text string"))
    got = lexical.search(docs, items, **limits)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == plain_search(odd_corpus(), QUERIES)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(odd_corpus(), "doc_id long, text string")
    items = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id >= 900 and doc_id < 903"), items).count() == 0


def test_best_positions_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    n = 20_000
    early = 0
    for _ in range(20):
        lists, whole = [], np.zeros(n, np.int64)
        times = [int(x) for x in rng.integers(1, 4, 4)]
        for t in times:
            at = np.sort(rng.choice(n, rng.integers(50, n), replace=False))
            impact = rng.integers(1, 50, len(at)) ** 4
            lists.append(lexical.ImpactList(at, impact, n))
            whole[at] += t * impact
        docs, score, depth = lexical.best_positions(lists, times, n, 20)
        want = np.lexsort((np.arange(n), -whole))[:20]
        order = np.lexsort((docs, -score))[:20]
        assert (docs[order] == want).all()
        assert (score[order] == whole[want]).all()
        early += depth < max(len(x.docs) for x in lists)
    assert early > 10


# ---------------------------------------------------------------- HTML extraction


def test_pages_of_the_test_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, source in rows:
        body = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert got[page_id] == (url, text, len(text))


def paragraph(i, n=25):
    return f"<p>Sentence {i} " + " ".join(f"word{j}" for j in range(n)) + ".</p>"


PAGES = {
    # no element names the article; menus, notices, forms and comments around it
    "plain": (
        "<html><body><div id='top-nav'><a href=/>Home</a> <a href=/b>Blog with a fairly long name</a></div><div class='cookie-notice'><p>We use cookies to make "
        "this site better for you and all of us</p><button>OK</button></div><div class=content><h1>Title</h1>" + paragraph(1) + "<div class='ad-box'>Buy now</div>" + paragraph(2)
        + "<form><label>Mail</label><input name=q><p>Subscribe to the letter</p></form>" + paragraph(3) + "</div><section id=comments><h2>Comments</h2>"
        + "".join(f"<div class='comment'><p>Reader {i} says a lot about this and that and more</p></div>" for i in range(9)) + "</section>"
        "<div class=sidebar><ul><li>one</li></ul></div><footer><p>All rights reserved by the owner</p></footer></body></html>",
        ["Title", 1, 2, 3],
    ),
    # comments are articles of their own, an aside stands between paragraphs, tags stay open
    "main": (
        "<!doctype html><header><h1>Site</h1></header><main><article><header><h1>A &amp; B</h1></header>" + paragraph(1) + "<aside><p>Related links and other things</p></aside>"
        + "<ul><li>first<li>second <b>bold</b>ly</ul><table><tr><td>c1<td>c2</table>" + paragraph(2) + "</article><section><article class=comment>" + paragraph(8) + "</article></section></main>"
        "<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {}</style>",
        ["A & B", 1, "first", "second boldly", "c1", "c2", 2],
    ),
    "broken": ("<article><p>one<p>two &lt;b&gt; &eacute;&#233;&#x2014;&nbsp;x &unknown; a<br>b<!-- <p>no</p> --> c</b></div></article", ["one", "two <b> éé— x &unknown; a", "b c"]),
    "no markup": ("just  some\n words & more", ["just some words & more"]),
    "only menu": ("<nav><a href=/>Home</a></nav><footer>Imprint</footer>", []),
}


def test_pages_of_other_shapes(spark):
    learned = html.train(spark.read.parquet(f"{SF}/pages.parquet"))
    assert learned["p word"] > 1 > html.WORD_LEAST == learned[html.OFF]
    assert learned["article"] < learned["p"] < 0
    for name, (source, blocks) in PAGES.items():
        text = "\n".join(re.sub("<[^>]+>", "", paragraph(b)) if isinstance(b, int) else b for b in blocks)
        for weights in ({}, learned):
            assert html.main_text(source, weights) == text, name


def test_extraction_of_odd_rows(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x y</p>"), (3, "u", "<p>x y</p>"), (3, "u", "<p>x y</p>"), (4, "u", long), (5, "u", "<p>" * 3000 + "deep")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Counter(map(tuple, html.extract_text(pages).collect()))
    text = "\n".join(["word & more"] * 20_000)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "x y", 3), (3, "u", "x y", 3), (3, "u", "x y", 3), (4, "u", text, len(text)), (5, "u", "deep", 4)]
    assert got == Counter(want)
    assert html.extract_text(pages.limit(0)).count() == 0


def test_best_region_is_the_best_of_all_regions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-6, 6, rng.integers(0, 30)).astype(float)
        a, b = html.best_region(scores)
        best = max((scores[i:j].sum() for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert scores[a:b].sum() == max(best, 0)


# ---------------------------------------------------------------- Merkle manifest


def plain_manifest(rows):
    def h(parts):
        return sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        d, _, lang, source, n = r
        return h([field(d), field(source), field(lang), field(n), field(text)])

    def up(nodes):
        return [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        return levels

    trees = defaultdict(list)
    for r in rows:
        changed = lower(r[1]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, changed)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {t: climb([x[2] for x in sorted(trees[t])]) for t in names}
    outer = climb([inner[t][-1][0] for t in names])
    out = Counter()
    for at, t in enumerate(names):
        for i, (known, d, own, changed) in enumerate(sorted(trees[t])):
            folded, proof = changed, []
            for levels, k in ((inner[t], i), (outer, at)):
                for nodes in levels[:-1]:
                    first = k - k % 8
                    run = nodes[first : first + 8]
                    proof += run[: k % 8] + run[k % 8 + 1 :]
                    folded = h(run[: k % 8] + [folded] + run[k % 8 + 1 :])
                    k //= 8
            root = outer[-1][0]
            out[d if known else None, own, inner[t][-1][0], root, h(proof), folded, folded == root] += 1
    return out


def manifest_rows():
    rows = [(i, f"Text {i} ÄÖ" if i % 5 else f"text {i}", "en", f"s{i % 3}", i) for i in range(4200)]
    rows += [(i, f"Texte {i}", "fr", None, None) for i in range(9)]
    rows += [(i, "Allein", f"x{i}", "s", 6) for i in range(70)]
    rows += [(None, "A", "fr", "s", 1), (None, "A", "fr", "s", 1), (3, "b", "fr", "s", 1), (3, "B", "fr", "s", 1), (3, "B", "fr", "s", 1)]
    rows += [(7, None, None, None, None), (6, "", None, "", 0), (None, None, None, None, None), (8, "Long " * 50_000, "", "s", 250_000)]
    return rows


def test_manifest(spark):
    docs = clashing(spark.createDataFrame(manifest_rows(), DOCS)).repartition(5)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain_manifest(manifest_rows())


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame(manifest_rows(), DOCS)
    assert merkle.manifest(docs.limit(0)).count() == 0
    alone = [(7, "Ab", "en", "s", 2)]
    got = merkle.manifest(spark.createDataFrame(alone, DOCS)).collect()
    assert Counter(map(tuple, got)) == plain_manifest(alone)
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == sha256(b"").hexdigest()


def test_folding_hashes_no_left_sibling():
    nodes = [sha256(bytes([i])).hexdigest().encode() for i in range(30)]
    states = merkle.Midstates(merkle._levels(nodes, 30))
    for i in range(30):
        changed = [*nodes[:i], b"x" * 64, *nodes[i + 1 :]]
        assert states.fold(i, b"x" * 64) == merkle._levels(changed, 30)[-1][0]
        blind = merkle.Midstates(merkle._levels(nodes, 30))
        blind.levels = [[b"" if j < k and j >= k - k % 8 else n for j, n in enumerate(level)] for level, k in zip(blind.levels, (i, i // 8, i // 64), strict=True)]
        assert blind.fold(i, b"x" * 64) == states.fold(i, b"x" * 64)
