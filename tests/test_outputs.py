"""Gates over published files: real folders, broken files, and what waits for what."""

import json

from attestra.operators import gates as Q
from attestra.operators import outputs as Z
from attestra.sources.readers import read_outputs, read_routes

GOOD = {"manifest": {"counts": {"runs": 1, "candidates": 0}, "note": "n"}, "summary": {}, "runs": [{"provider_calls": 4}], "candidates": [], "health": []}


def found(df):
    return sorted((r.object_id, r.rule) for r in df.collect())


def write(folder, tree, files):
    (folder / tree).mkdir()
    for name, body in files.items():
        (folder / tree / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_monitoring_trees_from_files(spark, tmp_path):
    write(tmp_path, "good", GOOD)
    write(tmp_path, "gone", {k: v for k, v in GOOD.items() if k != "health"})
    write(tmp_path, "broken", {**GOOD, "runs": "{", "manifest": {"counts": []}})
    write(tmp_path, "lists", {**GOOD, "runs": {"items": [{"providerExecutions": [1] * 5}]}, "health": {"health": [{}]}, "candidates": {"items": 3}})
    write(tmp_path, "deep", {**GOOD, "runs": {"items": [{"providerExecutions": [1] * 5, "provider_calls": 0}, {}]}, "candidates": {"candidates": [{"status": "PUBLISHED"}, {"status": None}]}})
    assert found(Z.monitoring_files(read_outputs(spark, str(tmp_path)))) == [
        ("broken/runs", "FILE_UNPARSABLE"), ("deep/candidates/1", "LEAKED_CANDIDATE"), ("deep/manifest/counts/candidates", "COUNT_MISMATCH"), ("deep/manifest/counts/runs", "COUNT_MISMATCH"),
        ("deep/runs/0", "CALL_CAP_EXCEEDED"), ("gone/health", "FILE_MISSING"), ("lists/candidates", "NOT_AN_ARRAY")]


def test_counts_and_notes_of_other_types(spark):
    def tree(name, manifest):
        return [(name, n, json.dumps(manifest if n == "manifest" else b)) for n, b in GOOD.items()]

    rows = tree("a", {"counts": {"runs": "1"}, "note": 5}) + tree("b", {"counts": None, "note": "\t \n"}) + tree("c", {"counts": {"x": 1}, "note": "n"}) + tree("d", [1]) + tree("e", {"counts": {"runs": 1.0, "published": None}, "note": "n"})
    files = spark.createDataFrame(rows, "tree string, name string, body string")
    assert found(Z.monitoring_files(files)) == [
        ("a/manifest/counts/runs", "COUNT_MISMATCH"), ("a/manifest/note", "NO_NOTE"), ("b/manifest/counts", "COUNTS_MISSING"), ("b/manifest/note", "NO_NOTE"), ("c/manifest/counts", "COUNTS_UNKNOWN"),
        ("d/manifest/counts", "COUNTS_MISSING"), ("d/manifest/note", "NO_NOTE"), ("e/manifest/counts/published", "COUNT_MISMATCH")]
    assert found(Z.monitoring_files(files.limit(0))) == []


def test_evidence_exports(spark):
    rows = [(t, n, "{}") for t in ("ok", "null", "cut") for n in Z.EVIDENCE_FILES]
    rows += [("part", "manifest", "{}")]
    files = spark.createDataFrame(rows, "tree string, name string, body string").selectExpr(
        "tree", "name", "CASE WHEN name <> 'spans' OR tree IN ('ok', 'part') THEN body WHEN tree = 'null' THEN 'null' ELSE '{' END AS body")
    assert found(Z.evidence_files(files)) == [("cut", "EVIDENCE_MISSING"), ("null", "EVIDENCE_MISSING"), ("part", "EVIDENCE_MISSING")]
    claims = spark.createDataFrame([("CLM-1", "x")], "id string, text string")
    assert found(Q.evidence(claims, None, claims, claims, claims, claims)) == [("evidence", "EVIDENCE_MISSING")]


def test_built_pages_and_missing_manifest(spark, tmp_path):
    for name in ("clm-1", "clm-3"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "index.html").write_text("<p>")
    claims = spark.createDataFrame([(f"clm-{i}", "t", "OPEN", False, [], None) for i in (1, 2, 3)], "id string, text string, status string, superseded boolean, supersededBy array<string>, supersededReason string")
    shards = claims.selectExpr("id", "text AS proposition", "'w' AS status_explanation", "concat('/claims/', id, '/') AS path", "1 AS independent_upstreams", "1 AS source_records", "'ok' AS body")
    nowhere = claims.limit(0).selectExpr("id AS document", "id AS claim_id")
    told = spark.createDataFrame([], "measure string, value long")
    built = read_routes(spark, str(tmp_path))
    assert found(Q.claim_outputs(claims, told, shards, nowhere, claims, built_pages=built, built_json=claims.filter("id <> 'clm-1'"))) == [("clm-1", "NO_JSON_PUB"), ("clm-2", "NO_ROUTE_HTML"), ("manifest", "NO_MANIFEST")]
    # a listing of another length; without a site build nothing is asked of it
    from attestra.operators.overview import claim_accounting

    assert found(Q.claim_outputs(claims, claim_accounting(claims), shards, nowhere, claims, listed=claims.union(claims))) == [("routes", "COUNT_ROUTES")]
    assert found(Q.claim_outputs(claims, claim_accounting(claims), shards, nowhere, claims, listed=claims)) == []


def test_snapshot_pages(spark):
    ids = spark.createDataFrame([("S1",), ("S2",)], "snapshot_id string")
    assert found(Q.snapshot_pages(ids, ids.filter("snapshot_id = 'S1'"))) == [("S2", "SNAPSHOT_PAGE_MISSING")]
