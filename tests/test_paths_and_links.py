"""Paths, carried facts, mentions and bridges against plain versions."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from attestra.operators import evidence as E
from attestra.operators import graph as G
from attestra.operators import overview as O


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def hops(edges, start, goal):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    dist, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x] - dist.keys():
            dist[y] = dist[x] + 1
            queue.append(y)
    return dist.get(goal)


def assert_path(rows, edges, start, goal, length):
    rows = sorted(rows, key=lambda r: r.step)
    assert [r.step for r in rows] == list(range(length + 1)) and {r.hops for r in rows} == {length}
    assert (rows[0].node, rows[-1].node) == (start, goal)
    linked = {frozenset(e) for e in edges}
    assert all(frozenset((a.node, b.node)) in linked for a, b in zip(rows, rows[1:]))


def test_a_path_of_five_thousand_hops(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(5000)]
    edges += [(f"n{i}", f"leaf{i}") for i in range(500, 5000, 500)]  # blind ends
    edges += [("n100", "by0"), ("by0", "by1"), ("by1", "by2"), ("by2", "n102")]  # a longer way round
    edges += [("n3000", "cut"), ("cut", "n3004")]  # a shorter one
    edges += [(f"ring{i}", f"ring{(i + 1) % 50}") for i in range(50)]
    rows = G.shortest_path(frame(spark, edges), "n0", "n5000", plain_rounds=2).collect()
    assert_path(rows, edges, "n0", "n5000", 4998)
    assert "cut" in {r.node for r in rows}


def test_paths_in_random_graphs(spark):
    rng = random.Random(4)
    for n, m, rounds in ((30, 40, 0), (60, 65, 0), (40, 120, 12), (80, 85, 1)):
        edges = sorted({tuple(sorted((f"v{rng.randrange(n)}", f"v{rng.randrange(n)}"))) for _ in range(m)})
        start, goal = "v1", "v2"
        want = hops(edges, start, goal)
        rows = G.shortest_path(frame(spark, edges), start, goal, plain_rounds=rounds).collect()
        if want is None:
            assert rows == []
        else:
            assert_path(rows, edges, start, goal, want)


def test_path_to_itself_and_direct(spark):
    edges = frame(spark, [("a", "b"), ("b", "a"), ("a", "a")])
    assert [tuple(r) for r in G.shortest_path(edges, "a", "a").collect()] == [(0, "a", 0)]
    assert sorted(tuple(r) for r in G.shortest_path(edges, "a", "b", plain_rounds=0).collect()) == [(0, "a", 1), (1, "b", 1)]


def test_carried_facts_are_those_of_the_closure(spark):
    rng = random.Random(2)
    edges = [(f"a{rng.randrange(25)}", f"a{rng.randrange(25)}", rng.choice(["supports", "produces", "other"])) for _ in range(60)]
    e = spark.createDataFrame(edges, '"from" string, "to" string, role string'.replace('"', "`"))
    every = spark.createDataFrame([(f"a{i}",) for i in range(25)], "id string")
    leaves = [f"a{i}" for i in range(0, 25, 3)]
    facts = spark.createDataFrame([(x, x) for x in leaves], "node string, fact string")
    for depth in (1, 12):
        closure = G.support_closure(e, every, max_depth=depth).filter(F.col("node").isin(leaves))
        assert {tuple(r) for r in G.carry_up(e, facts, max_depth=depth).collect()} == {(r.root, r.node) for r in closure.collect()}
    assert G.carry_up(e, facts.limit(0)).count() == 0


NODES = [("n1", "Jan Novak"), ("n2", "V. Novakova"), ("n3", "Eva Novak"), ("n4", "Ab"), ("n5", None), ("n6", "The Ovak"), ("n0", "Žižka")]
TEXTS = [("t1", "met Novakova and NOVAK"), ("t2", "the novaks"), ("t3", "žižka? ab"), ("t4", None), ("t5", ""), ("t6", "nobody"), ("t2", "Ovakulum")]


def plain_mentions(longest):
    keys = defaultdict(list)
    for node, label in NODES:
        last = (label or "").lower().split()[-1:] or [""]
        if len(last[0]) > 3:
            keys[last[0]].append(node)
    rows = {(t, n, k) for t, text in TEXTS for k, ns in keys.items() for n in ns if k in (text or "").lower()}
    if not longest:
        return rows
    best = {}
    for t, n, k in rows:
        best[t] = min(best.get(t, (0, "~")), (-len(k), n))
    return {(t, n) for t, (_, n) in best.items()}


def test_mentions(spark):
    nodes = spark.createDataFrame(NODES, "id string, label string")
    texts = spark.createDataFrame(TEXTS, "id string, text string")
    for limits in ({}, {"most_keys": 1}):
        assert {tuple(r) for r in O.mention_entities(texts, nodes, **limits).collect()} == plain_mentions(False)
        assert {tuple(r) for r in O.mention_entity(texts, nodes, **limits).collect()} == plain_mentions(True)
    assert O.mention_entity(texts, nodes.limit(0)).count() == 0 == O.mention_entity(texts.limit(0), nodes).count()
    plan = O.mention_entity(texts, nodes)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "flatten" not in plan


def test_related_counts_form_no_pairs_of_copies(spark):
    """A source that a third of all rows cites: 400 metrics by 400 claims, but one pair of source sets."""
    metrics = [(f"m{i}", ["hot"] if i < 400 else [f"s{i % 5}", "hot", "s1"] if i % 2 else [f"s{i % 7}", None]) for i in range(450)]
    claims = [(f"c{i}", "zisk 1" if i % 4 else "other", ["hot", "hot"] if i < 400 else [f"s{i % 3}"]) for i in range(450)]
    own, cited = O.related_bridges(spark.createDataFrame(metrics, "id string, sources array<string>"), spark.createDataFrame(claims, "id string, text string, sources array<string>"), O.FINANCE_WORDS)
    want = {m: {c for c, text, cs in claims if text == "zisk 1" and {x for x in ms if x} & set(cs)} for m, ms in metrics}
    assert {r.metric_id: r.related_claims for r in O.related_counts(own, cited).collect()} == {m: len(c) for m, c in want.items()}
    assert own.count() + cited.count() < 1000
    asked = spark.createDataFrame([("m401",), ("m2",)], "metric_id string")
    got = {tuple(r) for r in O.resolve_related(asked, own, cited).collect()}
    assert got == {(m, c) for m in ("m401", "m2") for c in want[m]}
    # no operator makes more rows than there are citations
    made = O._classes(own, "metric_id").count() * O._classes(cited, "claim_id").count()
    assert made < 200


def test_selector_counts(spark):
    selectors = spark.createDataFrame([("s1", "e", ["p", "q", "p"]), ("s2", "e", ["z"]), ("s3", "f", []), ("s4", None, ["p"])], "id string, entity string, predicates array<string>")
    assertions = spark.createDataFrame([(f"a{i}", "e", "p" if i % 2 else "q") for i in range(9)] + [("b", "f", "p")], "id string, entity string, predicate string")
    assert {tuple(r) for r in E.selector_counts(selectors, assertions).collect()} == {("s1", 9), ("s2", 0), ("s3", 0), ("s4", 0)}
    pairs = E.resolve_selectors(selectors, assertions)
    assert pairs.filter("selector_id = 's1'").count() == 9 and pairs.filter("assertion_id IS NULL").count() == 3
