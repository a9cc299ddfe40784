"""Outcomes of runs per source in event-time windows and sessions.

Two forms. Under a watermark Spark keeps the open windows in its state store, emits a
window once when it closes, and drops what comes later: state stays bounded. As a
ledger nothing is dropped: every batch is aggregated by itself and merged into a
bucketed table, so a row that comes after its window closed still counts, and is
counted as late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attestra.session import cut_lineage
from attestra.sources.buckets import BucketTable

WINDOW_SCHEMA = "source_id string, window_start timestamp, window_end timestamp, attempts long, failures long, last_run timestamp, late long"
SESSION_SCHEMA = "source_id string, session_start timestamp, session_end timestamp, attempts long, failures long, last_run timestamp"


def _counts(time: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") != "ok").alias("failures"), F.max(time).alias("last_run")]


def _usable(runs: DataFrame, time: str) -> DataFrame:
    return runs.filter(F.col("source_id").isNotNull() & F.col(time).isNotNull())


def outcome_windows(runs: DataFrame, width: str, time: str = "ts", slide: str | None = None) -> DataFrame:
    """Attempts and failures per source and window. ``runs``: source_id, outcome and the event time.

    Rows without source or time belong to no window. For a stream in append
    mode put ``withWatermark`` before it.
    """
    grouped = _usable(runs, time).groupBy("source_id", F.window(time, width, slide).alias("w")).agg(*_counts(time))
    return grouped.select("source_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts", "failures", "last_run")


def outcome_sessions(runs: DataFrame, gap: str, time: str = "ts") -> DataFrame:
    """Attempts and failures per source and session; a session ends ``gap`` after its last run."""
    grouped = _usable(runs, time).groupBy("source_id", F.session_window(time, gap).alias("s")).agg(*_counts(time))
    return grouped.select("source_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "attempts", "failures", "last_run")


def merge_sessions(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Sessions that touch become one. ``sessions``: rows of ``outcome_sessions`` from several batches.

    A source has one row for each stretch without a gap and batch, however many
    runs it had.
    """
    ahead = W.partitionBy(*by).orderBy("session_start", "session_end")
    reach = F.max("session_end").over(ahead.rowsBetween(W.unboundedPreceding, -1))
    opened = sessions.withColumn("_new_one", F.coalesce((F.col("session_start") > reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_session", F.sum("_new_one").over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_session").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("last_run").alias("last_run")).drop("_session")


class Clock:
    """Event time that the batches have reached, and the watermark that follows it by a delay."""

    def __init__(self, spark: SparkSession, path: str, delay: str):
        self.spark, self.path, self.delay = spark, path, delay

    def watermark(self, before: int | None = None) -> Column:
        """Newest time of the batches before ``before``, less the delay; null at first."""
        try:
            seen = self.spark.read.schema("batch long, newest timestamp").parquet(self.path)
            seen = seen if before is None else seen.filter(F.col("batch") < before)
            newest = seen.agg(F.max("newest")).first()[0]
        except AnalysisException:
            newest = None
        return F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")

    def advance(self, batch: DataFrame, batch_id: int, time: str) -> None:
        row = batch.agg(F.lit(batch_id).cast("long").alias("batch"), F.max(time).cast("timestamp").alias("newest"))
        row.coalesce(1).write.mode("append").parquet(self.path)


class OutcomeLedger:
    """Windows and sessions of a stream of runs, late rows included."""

    def __init__(self, spark: SparkSession, path: str, width: str, gap: str, delay: str, time: str = "ts", buckets: int = 64):
        self.path, self.width, self.gap, self.time = path, width, gap, time
        self.clock = Clock(spark, f"{path}/clock", delay)
        self._windows = BucketTable(spark, f"{path}/windows", ["source_id"], WINDOW_SCHEMA, buckets)
        self._sessions = BucketTable(spark, f"{path}/sessions", ["source_id"], SESSION_SCHEMA, buckets)

    @staticmethod
    def _add_windows(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_bucket", "source_id", "window_start", "window_end").agg(
            F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("last_run").alias("last_run"), F.sum("late").alias("late"))

    @staticmethod
    def _add_sessions(rows: DataFrame) -> DataFrame:
        return merge_sessions(rows, ["_bucket", "source_id"])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch of runs; adding the same batch again changes nothing."""
        batch = cut_lineage(batch)
        closed = F.coalesce(F.col("window_end") <= self.clock.watermark(batch_id), F.lit(False))
        counted = outcome_windows(batch, self.width, self.time)
        self._windows.upsert(counted.withColumn("late", F.when(closed, F.col("attempts")).otherwise(F.lit(0))), batch_id, self._add_windows)
        self._sessions.upsert(outcome_sessions(batch, self.gap, self.time), batch_id, self._add_sessions)
        self.clock.advance(batch, batch_id, self.time)

    def run(self, stream: DataFrame) -> None:
        """Take in everything that is available."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
        query.awaitTermination()

    def windows(self) -> DataFrame:
        """Windows with ``late``, the rows that came after the watermark had passed them, and ``closed``."""
        closed = F.coalesce(F.col("window_end") <= self.clock.watermark(), F.lit(False))
        return self._windows.read().withColumn("closed", closed)

    def sessions(self) -> DataFrame:
        """Sessions with ``closed``; an open one may still grow or join another."""
        closed = F.coalesce(F.col("session_end") <= self.clock.watermark(), F.lit(False))
        return self._sessions.read().withColumn("closed", closed)
