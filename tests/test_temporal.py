"""Valid time, extraction, field diff, classification, snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.time import parse_valid_time
from attestra.operators import snapshot as S
from attestra.operators.changes import build_changes, reconciliation
from attestra.operators.classify import categorize_change, classify_change
from attestra.operators.diff import diff_chain, diff_fields, diff_snapshots
from attestra.operators.extract import extract_objects
from attestra.operators.numbering import number_rows, number_within


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, value, precision",
    [
        ("2012-10-03", "2012-10-03", "EXACT_DATE"),
        ("2012-10", "2012-10", "MONTH"),
        ("2012", "2012", "YEAR"),
        ("3 October 2012", "2012-10-03", "EXACT_DATE"),
        ("14 Nov 2016", "2016-11-14", "EXACT_DATE"),
        ("14 Foo 2016", None, "UNKNOWN"),
        ("2016 or so", "2016", "YEAR"),
        ("soon", None, "UNKNOWN"),
        (None, None, "UNKNOWN"),
    ],
)
def test_valid_time_never_gains_precision(spark, raw, value, precision):
    got = one(spark, parse_valid_time(F.lit(raw).cast("string")))
    assert (got.value, got.precision) == (value, precision)


def test_hashes_and_slugs(spark):
    assert one(spark, X.fnv1a32(F.lit("a"))) == "e40c292c"
    assert one(spark, X.fnv1a32(F.lit("foobar"))) == "bf9cf968"
    assert one(spark, X.slugify(F.lit("  Žluťoučký Kůň, s.r.o. "))) == "zlutoucky-kun-s-r-o"
    assert one(spark, X.canonical_json(F.lit('{"b":1.50,"a":{"d":null,"c":[2,1]}}'))) == '{"a":{"c":[2,1],"d":null},"b":1.5}'


def doc(**over):
    base = {
        "meta": {"subject": "S", "evidenceCutoff": "2024-01-01"},
        "claims": [{"id": "CLM-1", "text": "t", "status": "CORROBORATED", "sources": ["b", "a"]}],
        "sources": [{"id": "a", "tier": 1, "kind": "official register", "retrievedAt": "2023-01-01"}],
        "openQuestions": ["Who  owns it?"],
        "timeline": [{"date": "2020", "event": "founded"}],
        "governance": {"statutoryBody": [{"name": "Jan Novák", "role": "CEO", "since": "2020-01-01", "until": None}], "signingRule": "two sign"},
        "financials": {"notFound": ["headcount"]},
        "graph": {"nodes": [{"data": {"id": "n1", "label": "N", "cats": ["y", "x"]}}], "edges": [{"data": {"id": "e1", "source": "n1", "target": "n2", "firstObserved": "2021"}}]},
    }
    return {**base, **over}


def objects_of(spark, tmp_path, *docs):
    frames = []
    for i, d in enumerate(docs):
        path = tmp_path / f"d{i}.json"
        path.write_text(json.dumps(d))
        o = extract_objects(spark.read.option("multiLine", True).json(str(path)))
        frames.append(o.withColumn("snapshot_sequence", F.lit(i + 1)).withColumn("snapshot_id", F.lit(f"SNAP-{i + 1}")).withColumn("evidence_cutoff", F.lit(f"{2022 + i}-12-31")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_extraction_covers_the_document(spark, tmp_path):
    rows = {r.object_type: r for r in objects_of(spark, tmp_path, doc()).collect()}
    assert set(rows) == {"case_meta", "claim", "source", "open_question", "timeline_event", "statutory_role", "governance_rule", "financial_fact", "entity", "relationship"}
    assert json.loads(rows["claim"].payload)["sources"] == ["a", "b"]
    assert rows["financial_fact"].object_id == "FIN-NOTFOUND-headcount"
    assert json.loads(rows["financial_fact"].payload)["status"] == "NOT_FOUND"
    assert (rows["relationship"].valid_from, rows["relationship"].valid_time_precision) == ("2021", "YEAR")
    assert rows["statutory_role"].object_id.startswith("ROLE-jan-novak-")
    assert rows["claim"].revision_id == "CLM-1@" + rows["claim"].content_hash


def test_reordered_sources_are_no_change(spark, tmp_path):
    again = doc(claims=[{"id": "CLM-1", "text": "t", "status": "CORROBORATED", "sources": ["a", "b"]}])
    o = objects_of(spark, tmp_path, doc(), again)
    hashes = {r.content_hash for r in S.semantic_hash(o, ["snapshot_id"]).collect()}
    assert len(hashes) == 1
    kinds = {r.change_kind for r in diff_snapshots(o.filter("snapshot_sequence = 1"), o.filter("snapshot_sequence = 2")).collect()}
    assert kinds == {"unchanged"}


def test_field_diff(spark):
    d = one(spark, diff_fields(F.lit('{"a":1,"s":["x","y"],"n":null}'), F.lit('{"a":2,"s":["y","z"]}')))
    assert [(f.field, f.kind, f.previous, f.current, f.added, f.removed) for f in d] == [("a", "value", "1", "2", None, None), ("s", "collection", None, None, ['"z"'], ['"x"'])]
    assert one(spark, diff_fields(F.lit('{"s":["x","y"]}'), F.lit('{"s":["y","x"],"n":null}'))) == []


SCENARIOS = [
    ("claim", "added", None, {"status": "CORROBORATED"}, ("CLAIM_ADDED", "LOW", "STRENGTHENED")),
    ("claim", "added", None, {"status": "SELF_REPORTED"}, ("CLAIM_ADDED", "LOW", "NO_EPISTEMIC_CHANGE")),
    ("source", "added", None, {"tier": 1}, ("SOURCE_ADDED", "MEDIUM", "STRENGTHENED")),
    ("relationship", "added", None, {"predicate": "OWNS", "status": "VERIFIED_PRIMARY"}, ("RELATIONSHIP_ADDED", "HIGH", "STRENGTHENED")),
    ("statutory_role", "added", None, {}, ("ROLE_CHANGED", "HIGH", "STRENGTHENED")),
    ("whatever", "added", None, {}, ("OBJECT_ADDED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE")),
    ("claim", "removed", {"status": "ASSESSED"}, None, ("OBJECT_REMOVED_FROM_PUBLICATION", "MEDIUM", "UNKNOWN")),
    ("claim", "changed", {"superseded": False}, {"superseded": True}, ("CLAIM_SUPERSEDED", "MEDIUM", "CORRECTED")),
    ("claim", "changed", {"status": "SELF_REPORTED"}, {"status": "CORROBORATED"}, ("STATUS_CHANGED", "MEDIUM", "STRENGTHENED")),
    ("claim", "changed", {"status": "BLOCKED"}, {"status": "NOT_FOUND"}, ("STATUS_CHANGED", "MEDIUM", "UNKNOWN")),
    ("claim", "changed", {"status": "CONTRADICTED"}, {"status": "ASSESSED"}, ("STATUS_CHANGED", "MEDIUM", "RESOLVED")),
    ("claim", "changed", {"text": "a"}, {"text": "b"}, ("CLAIM_CORRECTED", "MEDIUM", "CORRECTED")),
    ("claim", "changed", {"sources": ["a"]}, {"sources": ["a", "b"]}, ("EVIDENCE_ADDED", "LOW", "STRENGTHENED")),
    ("claim", "changed", {"sources": ["a"]}, {"sources": ["b"]}, ("OBJECT_ENRICHED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE")),
    ("contradiction", "changed", {"status": "CONTRADICTED"}, {"status": "RESOLVED"}, ("CONTRADICTION_RESOLVED", "MEDIUM", "RESOLVED")),
    ("statutory_role", "changed", {"until": None, "role": "a"}, {"until": "2024", "role": "b"}, ("VALIDITY_ENDED", "HIGH", "NO_EPISTEMIC_CHANGE")),
    ("relationship", "changed", {"target": "a"}, {"target": "b"}, ("OBJECT_CORRECTED", "HIGH", "CORRECTED")),
    ("financial_fact", "changed", {"display": "1"}, {"display": "2"}, ("FINANCIAL_VALUE_CORRECTED", "HIGH", "CORRECTED")),
    ("case_meta", "changed", {"a": 1}, {"a": 2}, ("PUBLICATION_METADATA_CHANGED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE")),
    ("entity", "changed", {"a": 1}, {"a": 2}, ("OBJECT_ENRICHED", "LOW", "NO_EPISTEMIC_CHANGE")),
]


def test_classification_scenarios(spark):
    text = lambda p: None if p is None else json.dumps(p)
    rows = [(i, t, k, text(o), text(n)) for i, (t, k, o, n, _) in enumerate(SCENARIOS)]
    df = spark.createDataFrame(rows, "i int, t string, k string, o string, n string")
    fields = F.coalesce(F.when(F.col("k") == "changed", diff_fields(F.col("o"), F.col("n"))), F.from_json(F.lit("[]"), "array<struct<field:string,kind:string,previous:string,current:string,added:array<string>,removed:array<string>>>"))
    got = df.withColumn("f", fields).select("i", classify_change(F.col("k"), F.col("t"), F.col("o"), F.col("n"), F.col("f")).alias("c")).collect()
    for r in got:
        assert tuple(r.c) == SCENARIOS[r.i][4], SCENARIOS[r.i]


def test_categories_compare_dates_as_text(spark):
    cat = lambda t, e: one(spark, categorize_change(F.lit(t), F.lit(e).cast("string"), F.lit("2025-01-01"), F.lit("2025-12-31")))
    assert cat("CLAIM_ADDED", "2025-06-01") == "WORLD_CHANGE"
    assert cat("CLAIM_ADDED", "2025") == "KNOWLEDGE_CHANGE"
    assert cat("CLAIM_ADDED", None) == "KNOWLEDGE_CHANGE"
    assert cat("CLAIM_CORRECTED", "2025-06-01") == "CORRECTION"
    assert cat("OBJECT_REMOVED_FROM_PUBLICATION", None) == "PUBLICATION_CHANGE"


def test_chain_and_reconciliation(spark, tmp_path):
    second = doc(claims=[{"id": "CLM-1", "text": "t", "status": "VERIFIED_PRIMARY", "sources": ["a", "b"]}, {"id": "CLM-2", "text": "u", "status": "ASSESSED", "sources": []}], openQuestions=["Other question?"])
    o = objects_of(spark, tmp_path, doc(), second, second)
    snaps = S.build_snapshot(o)
    pairs = S.adjacent_pairs(snaps)
    rec = {r.to_snapshot_id: r for r in reconciliation(diff_chain(o, pairs)).collect()}
    assert (rec["SNAP-2"].objects_added, rec["SNAP-2"].objects_removed, rec["SNAP-2"].objects_changed) == (2, 1, 1)
    assert (rec["SNAP-3"].objects_added, rec["SNAP-3"].objects_removed, rec["SNAP-3"].objects_changed) == (0, 0, 0)
    assert all(r.to_identity and r.from_identity for r in rec.values())
    rows = build_changes(o, pairs).orderBy("change_id").collect()
    assert [r.change_id for r in rows] == ["CHG-0001", "CHG-0002", "CHG-0003", "CHG-0004"]
    assert [r.change_kind for r in rows] == ["added", "added", "removed", "changed"]
    assert S.chain_findings(snaps).count() == 0


def test_tree_hash_ignores_order_and_sees_every_line(spark, tmp_path):
    o = objects_of(spark, tmp_path, doc())
    first = S.semantic_hash(o, ["snapshot_id"]).first()
    assert first.hash_mode == "tree"
    assert S.semantic_hash(o.repartition(5), ["snapshot_id"]).first().content_hash == first.content_hash
    lost = o.orderBy("object_type", "object_id").limit(o.count() - 1)
    assert S.semantic_hash(lost, ["snapshot_id"]).first().content_hash != first.content_hash


def revisions(spark, rows):
    """(sequence, id, hash) as object revisions."""
    df = spark.createDataFrame(rows, "snapshot_sequence int, object_id string, content_hash string")
    return df.select(
        "snapshot_sequence", F.lit("t").alias("object_type"), "object_id", F.concat_ws("@", "object_id", "content_hash").alias("revision_id"), "content_hash",
        F.lit(None).cast("string").alias("valid_from"), F.lit("UNKNOWN").alias("valid_time_precision"), F.to_json(F.struct(F.col("content_hash").alias("v"))).alias("payload"))


@pytest.mark.parametrize("listed", [[3, 5], [3, 5, 9], [1, 2, 3, 5, 9]])
def test_chain_pairs_neighbours_of_the_list_over_gaps(spark, listed):
    o = revisions(spark, [(3, "a", "1"), (3, "b", "1"), (3, "c", "1"), (4, "b", "8"), (4, "c", "1"), (4, "e", "1"), (5, "a", "1"), (5, "b", "2"), (5, "d", "1"), (9, "a", "3"), (9, "c", "1")])
    pairs = spark.createDataFrame(list(zip(listed, listed[1:])), "from_seq int, to_seq int")
    got = {(r.to_seq, r.object_id, r.change_kind) for r in diff_chain(o, pairs).collect()}
    want = set()
    for a, b in zip(listed, listed[1:]):
        side = lambda n: o.filter(F.col("snapshot_sequence") == n)
        want |= {(b, r.object_id, r.change_kind) for r in diff_snapshots(side(a), side(b)).collect()}
    assert got == want


def test_ids_outgrow_their_width(spark):
    from attestra.operators.numbering import ordinal_id

    ids = spark.range(99, 101).select(ordinal_id("SNAP-", F.col("id"), 2).alias("s")).collect()
    assert [r.s for r in ids] == ["SNAP-99", "SNAP-100"]


def test_path_of_seventy_hops(spark):
    from attestra.operators.graph import shortest_path

    edges = spark.range(70).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"))
    steps = shortest_path(edges, "n0", "n70").collect()
    assert len(steps) == 71 and {r.hops for r in steps} == {70}
    assert shortest_path(edges, "n0", "elsewhere").count() == 0


@pytest.mark.parametrize("text", ["", "a", "a\U0001F600", "ž\u4e2d"])
def test_fnv_hashes_utf16_units(spark, text):
    from attestra.functions.text import fnv1a32

    h, units = 2166136261, text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619) % 2**32
    assert spark.createDataFrame([(text,)], "t string").select(fnv1a32(F.col("t"))).first()[0] == f"{h:08x}"


def test_canonical_json_keeps_the_last_of_a_repeated_key(spark):
    from attestra.functions.text import canonical_json

    df = spark.createDataFrame([('{"b":1,"a":2,"b":3}',), ("{bad",)], "t string").select(canonical_json(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ['{"a":2,"b":3}', None]


def test_findings_about_a_table_survive_its_emptiness(spark):
    from attestra.operators import gates

    fresh = spark.createDataFrame([], "object_type string, object_id string, current_state string, materiality string")
    plan = spark.createDataFrame([], "task_id string, object_type string, object_id string, recommended_provider string, stop_condition string")
    assert [r.rule for r in gates.freshness(fresh, plan, "2001-01-20", "2000-12-31").collect()] == ["AS_OF_DIFFERS"]
    published = spark.createDataFrame([], "id string, gate_status string")
    told = spark.createDataFrame([], "measure string, value long")
    runs = spark.createDataFrame([], "run_id string")
    assert [r.rule for r in gates.monitoring(published, told, told, runs, None).collect()] == ["NO_NOTE"]


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3 == 0).alias("hot")).repartition(7)
    rows = number_rows(df, [F.col("k")], "n").collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i + 1) for i in range(1000)]
    within = number_within(df, ["hot"], [F.col("k")], "n").groupBy("hot").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.min("n").alias("l")).collect()
    assert all(r.c == r.m and r.l == 1 for r in within)


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_canonical_numbers_and_repeated_keys(spark, allowed):
    old = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    try:
        texts = ['{"a":1e3}', '{"a":1000}', '{"a":1000.0}', '{"a":5,"a":1000}', '{"a":10.00e2}']
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.content_hash(X.canonical_json(F.col("t"))).alias("h"))
        assert len({r.h for r in rows.collect()}) == 1
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", old)


@pytest.mark.parametrize("raw, spelled", [
    ("1e21", "1e+21"), ("1E-7", "1e-7"), ("0.000001", "0.000001"), ("1.5E-7", "1.5e-7"), ("-0.0", "0"), ("12345678901234567890", "12345678901234567000"), ("1e20", "100000000000000000000"),
    ("0.1", "0.1"), ("100", "100"), ("2.50", "2.5"), ("1.2345678901234567E-6", "0.0000012345678901234567"), ("-1e22", "-1e+22"), ("9007199254740993", "9007199254740992"),
])
def test_numbers_have_one_spelling(spark, raw, spelled):
    text = f'{{"x":[{raw},"{raw}",null,true],"1e3":"a\\\\\\"1e3"}}'
    assert one(spark, X.canonical_json(F.lit(text))) == f'{{"1e3":"a\\\\\\"1e3","x":[{spelled},"{raw}",null,true]}}'


def test_long_strings_survive_canonical_json(spark):
    text = json.dumps({"a": 'x"\\\n' * 20_000, "n": 1.50})
    assert one(spark, X.canonical_json(F.lit(text))) == json.dumps({"a": 'x"\\\n' * 20_000, "n": 1.5}, separators=(",", ":"))
