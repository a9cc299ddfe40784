"""Readers, sinks and streams on temporary folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestra.operators import evidence as E
from attestra.operators import snapshot as S
from attestra.sources import readers as R
from attestra.sources import writers as W
from attestra.streaming import streams as T


def test_ledger_skips_blank_and_corrupt_lines(spark, tmp_path):
    (tmp_path / "runs.ndjson").write_text('{"run_id":"a","outcome":"ok"}\n\n{"run_id":\n{"run_id":"b","outcome":"http_error"}\n')
    schema = "run_id STRING, outcome STRING"
    assert {r.run_id for r in R.read_ledger(spark, str(tmp_path), schema).collect()} == {"a", "b"}
    stream = T.run_to_table(R.stream_ledger(spark, str(tmp_path), schema), str(tmp_path / "out"))
    assert {r.run_id for r in stream.collect()} == {"a", "b"}


def test_artifacts_are_verified_by_their_bytes(spark, tmp_path):
    store = tmp_path / "store" / "sub"
    store.mkdir(parents=True)
    (store / "good.txt").write_bytes(b"hello")
    (store / "bad.txt").write_bytes(b"changed")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("1", "sub/good.txt", sha(b"hello")), ("2", "sub/bad.txt", sha(b"original")), ("3", "sub/gone.txt", sha(b"x"))], "artifact_id string, storage_path string, sha256 string")
    rows = R.read_artifacts(spark, str(tmp_path / "store"), manifest)
    files = rows.filter("content IS NOT NULL").select(F.col("storage_path").alias("path"), "content")
    found = {r.artifact_id: r.rule for r in E.verify_artifacts(manifest, files).collect()}
    assert found == {"2": "ARTIFACT_HASH_MISMATCH", "3": "ARTIFACT_FILE_MISSING"}


def test_text_lines_pages_and_observations(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    assert [(r.line, r.text) for r in R.read_text_lines(spark, str(tmp_path / "t")).orderBy("line").collect()] == [(1, "one"), (2, "two"), (3, "")]
    (tmp_path / "site" / "x").mkdir(parents=True)
    (tmp_path / "site" / "x" / "index.html").write_text("<title>x</title>")
    assert [(r.path, r.html) for r in R.read_pages(spark, str(tmp_path / "site"), "https://s").collect()] == [("x/index.html", "<title>x</title>")]
    obs = tmp_path / "obs"
    obs.mkdir()
    (obs / "p1.t1.json").write_text(json.dumps({"provider": "p1", "target": "t1", "status": "OK", "fields": {"ico": "1"}}))
    (obs / "p2.t1.json").write_text("{nope")
    got = {r.provider: (r.status, r.fields, r.corrupt) for r in R.read_observations(spark, str(obs)).collect()}
    assert got["p1"] == ("OK", {"ico": "1"}, False) and got["p2"][2] is True


def test_append_if_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("h1", "u1"), ("h1", "u1"), ("h2", "u1")], "sha256 string, url string")
    for _ in range(2):
        W.append_if_new(df, path, ["sha256", "url"])
    assert W.read_appended(spark, path).columns == ["sha256", "url"]
    assert W.read_appended(spark, path).count() == 2


def test_a_batch_opens_only_the_folders_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "a")
    W.append_if_new(spark.range(2000).selectExpr("cast(id as string) AS sha256", "id AS payload"), path, ["sha256"])
    folders = len([p for p in (tmp_path / "a").iterdir() if p.name.startswith(W.PREFIX)])
    assert folders > 200
    batch = spark.createDataFrame([("5", -1), ("new", -2)], "sha256 string, payload long")
    prefixes = [r[0] for r in batch.select(W._prefix(["sha256"], 2)).collect()]
    opened = W.known_keys(spark, path, ["sha256"], prefixes).select(F.input_file_name()).distinct().count()
    assert opened <= 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    W.append_if_new(batch, path, ["sha256"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert W.read_appended(spark, path).filter("payload < 0").collect()[0].sha256 == "new"


def test_write_if_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert W.write_if_changed(df, path) == "written"
    assert W.write_if_changed(df.repartition(5).orderBy(F.desc("id")), path) == "unchanged"
    assert W.write_if_changed(df.withColumn("v", F.col("id")), path) == "written"


def test_snapshot_is_never_overwritten(spark, tmp_path):
    cols = "object_type string, object_id string, content_hash string, payload string, revision_id string, valid_from string, valid_to string, snapshot_id string"
    make = lambda h: spark.createDataFrame([("claim", "1", h, "{}", "1@" + h, None, None, "SNAP-1")], cols)
    path = str(tmp_path / "s")
    manifest = lambda o: S.semantic_hash(o, ["snapshot_id"])
    assert W.persist_snapshot(make("a"), manifest(make("a")), path) == "written"
    assert W.persist_snapshot(make("a"), manifest(make("a")), path) == "kept"
    with pytest.raises(W.SnapshotConflict):
        W.persist_snapshot(make("b"), manifest(make("b")), path)
    assert spark.read.parquet(f"{path}/objects").count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "A")], "id string, status string")
    W.export_with_header(df, str(tmp_path / "e"), "claims", "2024-01-01", "status")
    head = spark.read.json(str(tmp_path / "e" / "header")).first()
    assert head["count"] == 3 and head["tally"].asDict() == {"A": 2, "B": 1}
    W.export_shards(df, str(tmp_path / "x"), "id", buckets=4)
    assert {r.key: json.loads(r.json)["status"] for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {"1": "A", "2": "B", "3": "A"}


def test_changes_by_stream_do_not_regress(spark, tmp_path):
    schema = "target string, provider string, at string, status string, field string, value string"
    rows = [("t", "p", "1", "OK", "owners", "A"), ("t", "p", "3", "OK", "owners", "B"), ("t", "p", "2", "ERROR", None, None), ("t", "p", "4", "OK", "owners", ""), ("t", "p", "5", "OK", "note", "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "d=1"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    T.detect_changes(read(), str(tmp_path / "o"))
    late = [("t", "p", "2", "OK", "owners", "old"), ("t", "p", "6", "OK", "owners", "C")]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "d=2"))
    got = T.detect_changes(read(), str(tmp_path / "o")).orderBy("at").collect()
    assert [(r.before, r.after, r.at) for r in got] == [("A", "B", "3"), ("B", "C", "6")]
