"""Sources, monitoring, graph, finance, addresses and gates on small fixtures."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import address as A
from attestra.operators import finance as N
from attestra.operators import gates as Q
from attestra.operators import graph as G
from attestra.operators import monitor as M
from attestra.operators import sources as S


def test_mirrors_are_one_authority(spark):
    model = spark.createDataFrame([("a", "reg", "register_mirror"), ("b", "reg", "primary_registry_document"), ("m1", "x", "media"), ("m2", "y", "media"), ("own", "me", "company")],
                                  "source_id string, upstream string, class string")
    claims = spark.createDataFrame([("1", "CORROBORATED", "x", ["a", "b"]), ("2", "CORROBORATED", "owner", ["m1", "m2"]), ("3", "SELF_REPORTED", "x", ["own"]), ("4", "ASSESSED", "x", [])],
                                   "id string, status string, text string, sources array<string>")
    r = {x.id: x for x in S.source_diversity(claims, model, "me").collect()}
    assert (r["1"].independent_upstreams, r["1"].monoculture, r["1"].primary_direct_count) == (1, True, 1) and r["1"].note
    assert (r["2"].independent_upstreams, r["2"].monoculture, r["2"].materiality) == (2, False, "high")
    assert r["3"].company_controlled_only and not r["4"].company_controlled_only
    assert r["4"].independent_upstreams == 0


def test_missing_provider_is_health_only(spark):
    expected = spark.createDataFrame([("p1", "t"), ("p2", "t"), ("p3", "t")], "provider string, target string")
    records = spark.createDataFrame([("p1", "t", "OK", {"legalName": "A"}, False), ("p3", "t", "OK", None, False)], "provider string, target string, status string, fields map<string,string>, corrupt boolean")
    r = {x.provider: x for x in M.provider_results(expected, records).collect()}
    assert (r["p1"].ok, r["p2"].status, r["p2"].error, r["p3"].status) == (True, "UNAVAILABLE", "fixture-missing", "ERROR")


def test_first_run_emits_nothing_and_absence_is_no_change(spark):
    schema = "target string, field string, value string"
    seen = spark.createDataFrame([("t", "owners", "B"), ("t", "status", "S")], schema)
    none = spark.createDataFrame([], schema)
    assert M.candidate_transitions(none, seen, "now", "p").count() == 0
    prior = spark.createDataFrame([("t", "owners", "A"), ("t", "address", "x")], schema)
    got = M.classify_candidates(M.candidate_transitions(prior, seen, "now", "p")).collect()
    assert [(c.field, c.before, c.after, c.requires_review) for c in got] == [("owners", "A", "B", True)]
    kept = {r.field: r.value for r in M.merge_baseline(prior, seen).collect()}
    assert kept == {"owners": "B", "address": "x", "status": "S"}


def test_review_gate(spark):
    c = spark.createDataFrame([("1", True), ("2", True), ("3", True), ("4", False), ("5", False)], "id string, requires_review boolean")
    a = spark.createDataFrame([("1", "approve", "r", "1"), ("2", "reject", "r", "1"), ("5", "reject", "r", "1"), ("5", "approve", "r", "2")], "candidate_id string, decision string, reviewer string, at string")
    r = {x.id: x.gate_status for x in M.review_gate(c, a).collect()}
    assert r == {"1": "APPROVED", "2": "REJECTED", "3": "PENDING_REVIEW", "4": "AUTO_APPROVED", "5": "REJECTED"}


def test_components_and_paths(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x")]
    e = spark.createDataFrame(chain, "source string, target string")
    labels = {r.node: r.component for r in G.connected_components(e).collect()}
    assert labels["n040"] == "n000" and labels["z"] == "x" and len(labels) == 44
    path = G.shortest_path(e, "n003", "n007").orderBy("step").collect()
    assert [r.node for r in path] == ["n003", "n004", "n005", "n006", "n007"] and path[0].hops == 4
    assert G.shortest_path(e, "n003", "x").count() == 0


def test_closure_survives_cycles_and_respects_depth(spark):
    e = spark.createDataFrame([("a", "b", "supports"), ("b", "c", "supports"), ("c", "a", "supports"), ("d", "c", "assumes")] + [(f"k{i}", f"k{i + 1}", "produces") for i in range(20)],
                              "from string, to string, role string")
    roots = spark.createDataFrame([("c",), ("k20",)], "id string")
    got = {(r.root, r.node): r.depth for r in G.support_closure(e, roots).collect()}
    assert {n for r, n in got if r == "c"} == {"a", "b"}
    assert max(d for (r, _), d in got.items() if r == "k20") == 13


def test_filed_figures(spark):
    d = spark.createDataFrame([("firm", "Net turnover (FY2024 / FY2023)", "36,319 / 42,642 tis. CZK (filed)", "V"), ("firm", "Registered capital", "243,715 CZK", "V"), ("firm", "Mood", "good", "V")],
                              "entity string, metric string, display string, status string")
    f = {(r.concept, r.period): (r.value, r.unit) for r in N.financial_facts(d, ["FY2024", "FY2023"]).collect()}
    assert f == {("net_turnover", "FY2024"): (36319.0, "thousand_czk"), ("net_turnover", "FY2023"): (42642.0, "thousand_czk"), ("registered_capital", "as_filed"): (243715.0, "czk")}
    m = N.derived_metrics(N.financial_facts(d, ["FY2024", "FY2023"]), "FY2024", "FY2023").collect()
    assert [(r.metric, r.value) for r in m] == [("turnover_growth", -14.8)]


def test_each_filing_has_its_own_periods(spark):
    rows = [("c1", "Net turnover", "20 / 10 CZK", ["FY2001", "FY2000"], "S"), ("c1", "Net turnover", "10 CZK", ["FY2000", "FY1999"], "S"), ("c1", "Net turnover", "CZK", ["FY1990"], "S")]
    d = spark.createDataFrame(rows, "entity string, metric string, display string, periods array<string>, status string")
    got = sorted((r.period, r.value) for r in N.financial_facts(d, "periods").collect())
    assert got == [("FY2000", 10.0), ("FY2000", 10.0), ("FY2001", 20.0)]


@pytest.mark.parametrize(
    "raw, street, house, orientation, part, postcode, city, resolution",
    [
        ("Dlouhá 526/5, Staré Město, 110 00 Praha", "Dlouhá", "526", "5", "Staré Město", "110 00", "Praha", "exact"),
        ("Dlouhá 526, Praha", "Dlouhá", "526", None, None, None, "Praha", "exact"),
        ("Dlouhá, Praha, Praha", "Dlouhá", None, None, None, None, "Praha", "partial"),
        ("", None, None, None, None, None, None, "unresolved"),
    ],
)
def test_address_components(spark, raw, street, house, orientation, part, postcode, city, resolution):
    a = spark.createDataFrame([(raw,)], "raw string").select(A.parse_address(F.col("raw")).alias("a")).first().a
    assert tuple(a) == (street, house, orientation, part, postcode, city, resolution)


def test_gates_pass_clean_input_and_catch_planted_defects(spark):
    sources = spark.createDataFrame([("s1",)], "id string")
    clean = spark.createDataFrame([("c", ["s1"])], "id string, sources array<string>")
    Q.assert_clean(Q.sourcing(clean, clean, sources))
    broken = spark.createDataFrame([("c", ["s9"]), ("d", [])], "id string, sources array<string>")
    rules = {r.rule for r in Q.sourcing(broken, clean, sources).collect()}
    assert rules == {"CLAIM_BAD_SOURCE", "CLAIM_NO_SOURCE"}
    with pytest.raises(AssertionError):
        Q.assert_clean(Q.sourcing(broken, clean, sources))
    text = spark.createDataFrame([("1", "born 850101/1234"), ("2", "all fine 12/34")], "id string, text string")
    assert [r.object_id for r in Q.privacy(text).collect()] == ["1"]
