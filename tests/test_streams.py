"""Streams that arrive in batches against the same work done at once."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestra.operators.numbering import lag_within, sum_before_within
from attestra.sources.buckets import BucketTable
from attestra.streaming import streams as S
from attestra.streaming.windows import OutcomeLedger, merge_sessions, outcome_sessions, outcome_windows

RUN = "run_id string, source_id string, outcome string, http_status int, ts timestamp"
START = datetime(2024, 1, 1)


def runs(n=400, seed=7):
    """A hot source holds half of all runs; a few rows lack source or time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 2 else f"s{rng.randrange(6)}"
        at = START + timedelta(minutes=rng.randrange(60 * 24 * 5))
        rows.append((f"r{i:04}", source, rng.choice(["ok", "ok", "http_error", "provider_error"]), rng.choice([200, 404, 500]), at))
    rows += [("x", None, "ok", 200, START), ("y", "s1", "ok", 200, None)]
    rng.shuffle(rows)
    return rows


def arriving(spark, folder, rows, batches):
    """``rows`` as files, one batch each."""
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], RUN).coalesce(1).write.parquet(str(folder / f"d={i}"))
    return spark.readStream.schema(RUN).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def plain_windows(rows):
    out = defaultdict(lambda: [0, 0, None])
    for _, source, outcome, _, at in rows:
        if source and at:
            day = at.replace(hour=0, minute=0)
            w = out[source, day, day + timedelta(days=1)]
            w[0] += 1
            w[1] += outcome != "ok"
            w[2] = max(w[2] or at, at)
    return {(*k, *v) for k, v in out.items()}


def plain_sessions(rows, gap):
    out = set()
    by = defaultdict(list)
    for _, source, outcome, _, at in rows:
        if source and at:
            by[source].append((at, outcome != "ok"))
    for source, seen in by.items():
        seen.sort()
        run = [seen[0]]
        for row in [*seen[1:], (datetime(9999, 1, 1), False)]:
            if row[0] > run[-1][0] + gap:
                out.add((source, run[0][0], run[-1][0] + gap, len(run), sum(f for _, f in run), run[-1][0]))
                run = []
            run.append(row)
    return out


def test_outcome_ledger_counts_late_rows(spark, tmp_path):
    rows = runs()
    ledger = OutcomeLedger(spark, str(tmp_path / "t"), "1 day", "2 hours", "6 hours", buckets=4)
    ledger.run(arriving(spark, tmp_path / "in", rows, 3))
    got = ledger.windows().collect()
    assert {tuple(r[c] for c in ("source_id", "window_start", "window_end", "attempts", "failures", "last_run")) for r in got} == plain_windows(rows)
    # the first batch reaches to the last day, so the other two come late for all days but that one
    assert sum(r.late for r in got) > 200
    assert {r.window_start.day for r in got if not r.closed} <= {5}
    sessions = {tuple(r)[:6] for r in ledger.sessions().select("source_id", "session_start", "session_end", "attempts", "failures", "last_run").collect()}
    assert sessions == plain_sessions(rows, timedelta(hours=2))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows = runs(60)
    ledger = OutcomeLedger(spark, str(tmp_path / "t"), "1 day", "2 hours", "6 hours", buckets=4)
    first, second = spark.createDataFrame(rows[:30], RUN), spark.createDataFrame(rows[30:], RUN)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        ledger.add(batch, number)
    assert sum(r.attempts for r in ledger.windows().collect()) == 60
    assert sum(r.attempts for r in ledger.sessions().collect()) == 60


def test_windows_under_a_watermark_drop_only_late_rows(spark, tmp_path):
    rows = sorted((r for r in runs() if r[4]), key=lambda r: r[4])
    late = [("late", "hot", "ok", 200, START + timedelta(minutes=1))]
    folder = tmp_path / "in"
    # Spark drops by the watermark of the batch before, so the late row is in the third one
    for i, part in enumerate((rows[:300], rows[300:], [*late, ("end", "hot", "ok", 200, START + timedelta(days=30))])):
        spark.createDataFrame(part, RUN).coalesce(1).write.parquet(str(folder / f"d={i}"))
    stream = spark.readStream.schema(RUN).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "6 hours")
    got = S.run_to_table(outcome_windows(stream, "1 day"), str(tmp_path / "w"))
    assert {tuple(r) for r in got.collect()} == plain_windows(rows)
    got = S.run_to_table(outcome_sessions(stream, "2 hours"), str(tmp_path / "s"))
    assert {tuple(r) for r in got.collect()} == plain_sessions(rows, timedelta(hours=2))


def test_sessions_of_batches_join_where_they_touch(spark):
    t = lambda h: START + timedelta(hours=h)
    rows = [("a", t(0), t(4), 2, 0, t(2)), ("a", t(6), t(9), 3, 1, t(7)), ("a", t(3), t(6), 1, 1, t(4)), ("a", t(20), t(22), 1, 0, t(20)), ("b", t(4), t(5), 1, 0, t(4))]
    merged = merge_sessions(spark.createDataFrame(rows, "source_id string, session_start timestamp, session_end timestamp, attempts long, failures long, last_run timestamp"), ["source_id"])
    assert {(r.source_id, r.session_start, r.session_end, r.attempts, r.failures) for r in merged.collect()} == {("a", t(0), t(9), 6, 2), ("a", t(20), t(22), 1, 0), ("b", t(4), t(5), 1, 0)}


def test_provider_state_in_batches(spark, tmp_path):
    rows = [r for r in runs() if r[4]]
    shape = lambda df: df.selectExpr("run_id", "source_id", "outcome", "http_status", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS finished_at")
    want = {tuple(r) for r in S.provider_state(shape(spark.createDataFrame(rows, RUN))).collect()}
    got = S.upsert_to_table(S.stream_provider_state(shape(arriving(spark, tmp_path / "in", rows, 4))), str(tmp_path / "t"), ["source_id"], buckets=4)
    assert {tuple(r) for r in got.collect()} == want


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], "k string, v long", buckets=16)
    table.upsert(spark.range(500).selectExpr("cast(id as string) AS k", "id AS v"), 0)
    table.upsert(spark.createDataFrame([("7", -7), ("fresh", 1)], "k string, v long"), 1)
    folders = lambda n: [p for p in (tmp_path / "t" / "rows" / f"write={n}").iterdir() if p.name.startswith("_bucket")]
    assert len(folders(0)) == 16 and len(folders(1)) <= 2
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 501 and rows["7"] == -7 and rows["8"] == 8
    # a write that broke off before its log line is not read; repeated, it replaces itself
    broken = tmp_path / "t" / "rows" / "write=2"
    spark.createDataFrame([("7", 99, 0)], "k string, v long, _bucket int").write.partitionBy("_bucket").parquet(str(broken))
    assert {r.k: r.v for r in table.read().collect()} == rows
    table.upsert(spark.createDataFrame([("8", 80)], "k string, v long"), 2)
    assert {r.k: r.v for r in table.read().collect()} == {**rows, "8": 80}


def test_change_detection_of_a_hot_field_in_batches(spark, tmp_path):
    rng = random.Random(3)
    schema = "target string, provider string, at string, status string, field string, value string"
    rows = []
    for i in range(300):
        target = "hot" if i % 3 == 0 else f"t{i % 5}"
        rows.append((target, rng.choice(["p1", "p2"]), f"{i // 2:05}", rng.choice(["OK", "OK", "OK", "ERROR"]), rng.choice(["owners", "note"]), rng.choice(["A", "B", "", None])))
    known, want = {}, set()
    for cut in (range(0, 100), range(100, 220), range(220, 300)):
        seen = {}
        for i in cut:
            target, provider, at, status, field, value = rows[i]
            if status == "OK" and field == "owners":
                seen[target, at] = max(seen.get((target, at), ("", "")), (provider, value or ""))
        for (target, at), (_, value) in sorted(seen.items(), key=lambda x: x[0][1]):
            before, since = known.get(target, (None, ""))
            if not value or at < since:
                continue
            if before and before != value:
                want.add((target, "owners", before, value, at))
            known[target] = (value, at)
        spark.createDataFrame([rows[i] for i in cut], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={cut.start:03}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got = S.detect_changes(stream, str(tmp_path / "t"), ["owners"])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours_and_sums_in_a_group_over_many_partitions(spark, partitions):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 4}", i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        lagged = {r.i: r.p for r in lag_within(df, ["g"], ["i"], "v", "p").collect()}
        sums = {r.i: r.s for r in sum_before_within(df.withColumn("v", F.coalesce("v", F.lit(0))), ["g"], ["i"], "v", "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    last, total = {}, defaultdict(int)
    for g, i, v in rows:
        assert lagged[i] == last.get(g) and sums[i] == total[g], i
        last[g] = v
        total[g] += v or 0
