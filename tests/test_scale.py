"""Plans that must not move rows more often than their job asks for."""

import re

import pytest
from pyspark.sql import functions as F

from attestra.operators import freshness as N
from attestra.operators import overview as O
from attestra.operators import snapshot as S
from attestra.operators.diff import diff_chain
from attestra.operators.numbering import number_rows
from attestra.plans.catalog import QUERIES
from attestra.plans.streams import mixed_runs
from attestra.session import stored

REVISIONS = "snapshot_sequence int, snapshot_id string, evidence_cutoff string, object_type string, object_id string, revision_id string, content_hash string, valid_from string, valid_to string, valid_time_precision string, payload string"


@pytest.fixture
def revisions(spark):
    rows = [(s, f"SNAP-{s:02d}", f"200{s}-12-31", "claim", f"C{i}", f"C{i}@{s > 1}", str(s > 1), None, None, "UNKNOWN", f'{{"status":"{s > 1}"}}') for s in (1, 2, 3) for i in range(20)]
    return spark.createDataFrame(rows, REVISIONS)


@pytest.fixture
def unknown_sizes(spark):
    """As for large tables: no side of a join is known to be small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    """Keys of the hash exchanges of a plan, the last one first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_diff_chain_deals_revisions_by_object_only(revisions, unknown_sizes):
    pairs = S.adjacent_pairs(revisions.select("snapshot_sequence", "snapshot_id", "evidence_cutoff").distinct())
    d = diff_chain(revisions, pairs)
    keys = [re.sub(r"#\d+L?", "", k) for k in exchanges(d)]
    assert not [k for k in keys if k.startswith(("to_seq", "snapshot_sequence,")) and "snapshot_id" not in k], keys
    assert {(r.to_seq, r.change_kind): r["count"] for r in d.groupBy("to_seq", "change_kind").count().collect()} == {(2, "changed"): 20, (3, "unchanged"): 20}


def test_tree_hash_deals_lines_once(revisions):
    tree = S.semantic_hash(revisions, ["snapshot_id"])
    keys = exchanges(tree)
    assert len(keys) == 2 and keys[0].startswith("snapshot_id") and "," not in re.sub(r", \d+$", "", keys[1]), keys
    assert tree.count() == 3


def test_numbered_rows_are_stored_compressed(spark):
    df = spark.range(50).select("id", F.repeat(F.lit("x"), 100).alias("wide"))
    rows = number_rows(df, [F.col("id")])
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.row_no) for r in rows.orderBy("id").collect()] == [(i, i + 1) for i in range(50)]
    again = number_rows(stored(df).select("id"), [F.col("id").desc()], "n", is_stored=True)
    assert [r.id for r in again.orderBy("n").collect()] == list(range(49, -1, -1))


def test_freshness_queries_cover_every_snapshot(spark):
    """Sources and cutoffs are those of a row's own snapshot; older snapshots are not left out."""
    def row(seq, kind, key, payload):
        return (seq, f"SNAP-{seq:02d}", f"200{seq}-12-31", kind, key, None, None, None, None, None, payload)

    rows = [row(1, "source", "S1", '{"retrievedAt":"2001-05-05"}'), row(2, "source", "S1", '{"retrievedAt":"2002-12-30"}'), row(2, "source", "S2", '{"retrievedAt":"2002-02-02"}')]
    rows += [row(s, "relationship", "R1", '{"predicate":"OWNS","status":"X","sources":["S2","S1"]}') for s in (1, 2)] + [row(1, "claim", "C1", '{"sources":["S2"]}')]
    o = spark.createDataFrame(rows, REVISIONS)
    by = ["snapshot_id"]
    told = {(r.snapshot_id, r.object_id): r.last_verification for r in N.last_verification(o, o, F.col("evidence_cutoff"), by).collect()}
    assert told == {("SNAP-01", "S1"): "2001-05-05", ("SNAP-02", "S1"): "2002-12-30", ("SNAP-02", "S2"): "2002-02-02", ("SNAP-01", "R1"): "2001-05-05", ("SNAP-02", "R1"): "2002-12-30", ("SNAP-01", "C1"): "2001-12-31"}
    as_of = F.date_format(F.date_add(F.to_date("evidence_cutoff"), 20), "yyyy-MM-dd")
    state = {r.snapshot_id: r.currentness_state for r in N.relationship_currentness(o, F.col("evidence_cutoff"), as_of, by).collect()}
    assert state == {"SNAP-01": "REVALIDATION_DUE", "SNAP-02": "CURRENT_AS_VERIFIED"}
    states = spark.createDataFrame([("S1", "OK", "2001-01-01", 3)], "source_id string, state string, last_attempt string, failed_attempts int")
    first = {(r.snapshot_id, r.object_id): r.provider.failed_attempts for r in N.first_provider_state(o, states, by).collect()}
    assert first == {("SNAP-01", "S1"): 3, ("SNAP-02", "S1"): 3, ("SNAP-01", "R1"): 3, ("SNAP-02", "R1"): 3}


@pytest.mark.parametrize("name", ["J12_last_verification", "J13_first_provider_state", "G9_relationship_currentness"])
def test_freshness_queries_return_every_snapshot(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.select("snapshot_id").distinct().count() == 10


def test_related_classes_hold_the_relation_of_all_metrics(spark):
    own = spark.createDataFrame([("m1", "a"), ("m2", "a"), ("m3", "b"), ("m3", "c"), ("m4", "z")], "metric_id string, source_id string")
    cited = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c3"), ("c", "c3"), ("a", "c4"), ("b", "c4")], "source_id string, claim_id string")
    rows = [tuple(r) for r in O.related_classes(own, cited).collect()]
    part = lambda name: {(i, ref) for p, i, ref in rows if p == name}
    assert part("metric") == {("m1", "m1"), ("m2", "m1"), ("m3", "m3"), ("m4", "m4")} and len(rows) == len(set(rows))
    metrics, claims = part("metric"), part("claim")
    spelled = {(m, c) for a, b in part("related") for m, rm in metrics if rm == a for c, rc in claims if rc == b}
    everything = own.join(cited, "source_id").select("metric_id", "claim_id").distinct().collect()
    assert spelled == {tuple(r) for r in everything}


def test_j20_answers_for_all_metrics(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["J20_related_claims"](spark, sf)
    assert rows.filter("part = 'metric'").count() == QUERIES["J20_metric_bridge"](spark, sf).select("metric_id").distinct().count() > 1


def test_batches_of_runs_follow_the_splits(spark, tmp_path):
    """Three batches of as many files as the table has splits, not three single files."""
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    splits = spark.read.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        wanted = splits.rdd.getNumPartitions()
        stream = mixed_runs(spark, str(tmp_path))
        sizes = []
        log = str(tmp_path / "log")
        stream.writeStream.foreachBatch(lambda b, i: sizes.append((b.select(F.input_file_name()).distinct().count(), b.count()))).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert wanted > 1 and sum(n for _, n in sizes) == splits.count() and len(sizes) in (2, 3)
    assert max(files for files, _ in sizes) > 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_components_draw_the_graph_together(spark, monkeypatch):
    """Each round works on fewer edges; labels are the smallest ids, also along chains and around hubs."""
    from attestra.operators import graph

    written = []
    keep = graph.stored

    def watched(df):
        out = keep(df)
        if out.columns == ["source", "target"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", watched)
    pairs = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(30)] + [("z", f"b{i}") for i in range(9)] + [("c1", "c1"), ("d1", None), ("d2", "d1"), ("d1", "d2")]
    labels = graph.connected_components(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([("a05",), ("e",)], "id string"))
    got = sorted((r.node, r.component) for r in labels.collect())
    assert got == sorted([(f"a{i:02d}", "a00") for i in range(31)] + [(n, "b0") for n in ["z", *[f"b{i}" for i in range(9)]]] + [("d1", "d1"), ("d2", "d1"), ("e", "e")])
    assert written[0] == 41 and written[1] <= 9 and written[-1] == 0


def test_replayed_objects_do_not_meet_by_version(spark):
    from attestra.sources.writers import replay

    versions = spark.createDataFrame([(1, [("C1", "x", "s", ["a"])])], "version long, claims array<struct<id:string,text:string,status:string,sources:array<string>>>")
    done = replay(versions, spark.createDataFrame([(1, "2001-12-31")], "version long, evidence_cutoff string"))
    assert "rightHint=(strategy=broadcast)" in plan_of(done)


def test_why_index_joins_its_rows_once(spark, monkeypatch):
    """One join for all sections, in partitions by the number of rows."""
    from attestra.operators import reasoning

    monkeypatch.setattr(reasoning, "ROWS_PER_TASK", 2)
    nodes = spark.createDataFrame([("n1",), ("n2",)], "id string")
    edges = spark.createDataFrame([("n1", "n2", "supports"), ("n2", "n1", "contextualizes"), ("n1", "x", "supports")], "from string, to string, role string")
    inferences = spark.createDataFrame([("n1", ["A"])], "produces string, assumptions array<string>")
    done = reasoning.why_index(nodes, edges, inferences)
    assert plan_of(done).count("Join LeftSemi") == 1
    got = sorted((r.node, r.section, r.ref) for r in done.collect())
    assert got == sorted([("n2", "supporting", "n1"), ("n1", "contextualizing", "n2"), ("n1", "used_by", "n2"), ("n1", "used_by", "x"), ("n2", "used_by", "n1"), ("n1", "assumptions", "A")])


def test_sorted_assertions_are_extracted_once(spark):
    from attestra.operators.register import sort_assertions

    rows = spark.createDataFrame([(["b", "a"],)], "x array<string>").selectExpr("'e' AS entity", "explode(x) AS predicate").selectExpr("entity", "predicate", "'i' AS id")
    done = sort_assertions(rows)
    assert "Generate" not in plan_of(done)
    assert [r.predicate for r in done.collect()] == ["a", "b"]


def test_revision_chain_hashes_no_table_of_revisions(spark):
    from attestra.operators.history import revision_chain

    rows = [("claim", i, s, h, f"{i}@{h}") for i, chain in (("c1", "1A 2A 4B 5A 6A"), ("c2", "3C"), (None, "1D 2D")) for s, h in ((int(p[0]), p[1:]) for p in chain.split())]
    done = revision_chain(spark.createDataFrame(rows, "object_type string, object_id string, snapshot_sequence int, content_hash string, revision_id string"))
    assert "Aggregate" not in plan_of(done)
    got = sorted((r.object_id or "", r.revision_number, r.revision_id, r.first_snapshot_sequence, r.last_snapshot_sequence) for r in done.collect())
    assert got == [("", 1, "None@D", 1, 2), ("c1", 1, "c1@A", 1, 2), ("c1", 2, "c1@B", 4, 4), ("c1", 3, "c1@A", 5, 6), ("c2", 1, "c2@C", 3, 3)]


def test_cited_texts_are_joined_in_partitions_by_their_bytes(spark, monkeypatch):
    from attestra.operators import evidence

    monkeypatch.setattr(evidence, "BYTES_PER_TASK", 100, raising=False)
    docs = spark.createDataFrame([(i, f"line {i}\nmore words of {i}\nend") for i in range(40)] + [(40, None)], "file long, body string")
    spans = spark.createDataFrame([(f"s{i}", i, 1 + i % 3, f"more words of {i}" if i % 2 else "nowhere") for i in range(42)] + [("n", None, 1, "x")], "id string, file long, line int, exact_text string")
    done = evidence.verify_citations(spans, docs)
    size = sum(len(r.body or "") for r in docs.collect())
    assert "RepartitionByExpression [file#" in plan_of(done) and f", {-(-size // 100)}" in plan_of(done)
    got = {r.id: r.match for r in done.collect()}
    assert got == {f"s{i}": "not found" if i % 2 == 0 else "exact" if i % 3 == 1 else "window" for i in range(40)} | {"s40": "file missing", "s41": "file missing", "n": "file missing"}

    web = docs.selectExpr("concat('w', file) AS id", "concat('t', file) AS artifact_tag", "array(substring(body, 1, 4), CASE WHEN file % 4 = 0 THEN 'nowhere' ELSE 'end' END) AS contains")
    told = evidence.verify_quotes(web, docs.selectExpr("concat('t', file) AS artifact_tag", "body"))
    assert "RepartitionByExpression [artifact_tag#" in plan_of(told)
    assert {r.id for r in told.filter("verified").collect()} == {f"w{i}" for i in range(40) if i % 4}


def test_changes_are_numbered_where_they_lie(spark, monkeypatch):
    """Numbers follow from ranges of objects; the change rows are not sorted a second time over all tasks."""
    from attestra.operators import changes as C

    def dealt_again(*args, **more):
        raise AssertionError("change rows are dealt out again")

    monkeypatch.setattr(C, "number_rows", dealt_again)
    rows = [(s, f"SNAP-{s:02d}", f"200{s}-12-31", t, f"{i:03d}", None, str((i + s) % 3), None, None, "UNKNOWN", f'{{"status":"{(i + s) % 3}"}}')
            for s in (1, 2, 3) for i in range(60) for t in ("claim", "relationship") if (i + s) % 5]
    o = spark.createDataFrame(rows, REVISIONS).withColumn("revision_id", F.concat_ws("@", "object_id", "content_hash"))
    pairs = S.adjacent_pairs(o.select("snapshot_sequence", "snapshot_id", "evidence_cutoff").distinct())
    done = C.build_changes(o, pairs).collect()
    order = lambda r: (r.to_seq, ["added", "removed", "changed"].index(r.change_kind), f"{r.object_type}:{r.object_id}")
    assert [r.change_id for r in sorted(done, key=order)] == [f"CHG-{n:04d}" for n in range(1, len(done) + 1)]
    assert {r.change_kind for r in done} == {"added", "removed", "changed"} and len(done) > 100


def test_derived_hashes_are_not_sent(spark):
    """A hash or id that follows from the row is left out of the shuffle; any other, and none, is kept as it is."""
    from attestra.functions import text as X
    from attestra.operators.diff import _sent

    rows = [(s, f"SNAP-{s:02d}", f"200{s}-12-31", "claim", i, r, h, None, None, "UNKNOWN", f'{{"status":"{s}"}}')
            for s in (1, 2) for i, r, h in (("own", None, None), ("other", f"r{s}", f"h{s}"), ("none", None, None))]
    o = spark.createDataFrame(rows, REVISIONS)
    own = F.col("object_id") == "own"
    o = o.withColumn("content_hash", F.when(own, X.content_hash(F.col("payload"))).otherwise(F.col("content_hash")))
    o = o.withColumn("revision_id", F.when(own, X.revision_id(F.col("object_id"), F.col("content_hash"))).otherwise(F.col("revision_id")))
    sent = {r.object_id: (r._hash, r._id) for r in _sent(o).filter("seq = 1").collect()}
    assert sent["own"] == (None, None) and sent["other"] == (("h1",), ("r1",)) and sent["none"] == ((None,), (None,))
    d = diff_chain(o, S.adjacent_pairs(o.select("snapshot_sequence", "snapshot_id", "evidence_cutoff").distinct()))
    told = {r.object_id: r for r in d.collect()}
    want = {(r.object_id, r.snapshot_sequence): (r.revision_id, r.content_hash) for r in o.collect()}
    for key, r in told.items():
        assert [(x.revision_id, x.content_hash) for x in (r.old, r.new)] == [want[key, 1], want[key, 2]]
    assert told["own"].change_kind == told["other"].change_kind == "changed" and told["none"].change_kind == "unchanged"


def test_layers_are_built_once(spark):
    done = QUERIES["J21_layer_agreement"](spark, "/root/testdata/sf0.001")
    assert plan_of(done).count("lineitem") <= 1 and plan_of(done).count("RepartitionByExpression") == 1


def test_affected_claims_find_differences_once(spark):
    done = QUERIES["J11_affected_claims"](spark, "/root/testdata/sf0.001")
    assert "Window" not in plan_of(done)
