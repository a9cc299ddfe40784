"""Structured Streaming forms of the monitoring loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from attestra import rules
from attestra.operators.evidence import provider_state
from attestra.operators.monitor import first_decisions, gate_status
from attestra.operators.numbering import lag_within
from attestra.session import cut_lineage
from attestra.sources.buckets import BucketTable
from attestra.sources.writers import append_if_new


def stream_provider_state(runs: DataFrame) -> DataFrame:
    """Provider state per source, kept up to date.

    The same aggregation as in batch: maxima over event time, so late rows
    never move a source back. ``upsert_to_table`` keeps it as a table.
    """
    return provider_state(runs)


def dedupe_artifacts(stream: DataFrame, keys: list[str], time: str = "retrieved_at", delay: str = "7 days") -> DataFrame:
    """Each (hash, URL) once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_artifacts(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each (hash, URL) once for ever: a batch is compared with the stored keys of its own hash prefixes."""

    def write(batch: DataFrame, _: int) -> None:
        append_if_new(batch, path, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_stream(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Candidates against the approval ledger, as a stream-static join."""
    decided = first_decisions(approvals).withColumnRenamed("candidate_id", "id")
    rows = candidates.join(decided, "id", "left")
    return rows.withColumn("gate_status", gate_status(F.col("decision"), F.col("requires_review")))


CHANGE_SCHEMA = "target STRING, field STRING, before STRING, after STRING, at STRING"
KNOWN_SCHEMA = "target STRING, field STRING, value STRING, at STRING"
FIELD = ["target", "field"]


def observed_fields(observations: DataFrame, material: list[str] | None = None) -> DataFrame:
    """Material fields of successful observations; failures never get further.

    ``observations``: target, provider, at, status, field, value.
    """
    wanted = F.col("field").isin(material or rules.MATERIAL_FIELDS) & (F.col("status") == "OK") & F.col("target").isNotNull() & F.col("at").isNotNull()
    return observations.filter(wanted).select("target", "field", "provider", "at", "value")


def changes_of_batch(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Real differences of a batch of ``observed_fields``, and the last known values after it.

    ``known``: target, field, value, at. Among the providers of one run the
    last one wins; an empty value says nothing, a value older than the known one
    changes nothing, and the first value only sets the baseline. Runs are
    aggregated before anything is ordered, and a field that holds a third of all
    rows is ordered over many partitions.
    """
    runs = batch.groupBy(*FIELD, "at").agg(F.max_by("value", F.struct("provider", "value")).alias("value")).filter("value <> ''")
    since = known.select(*FIELD, F.col("value").alias("_value"), F.col("at").alias("_since"))
    newer = runs.join(since, FIELD, "left").filter("_since IS NULL OR at >= _since")
    steps = cut_lineage(lag_within(newer, FIELD, ["at"], "value", "_step"))
    before = F.coalesce("_step", "_value")
    changed = steps.filter(before != F.col("value")).select(*FIELD, before.alias("before"), F.col("value").alias("after"), "at")
    latest = steps.groupBy(*FIELD).agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return changed, latest


def detect_changes(observations: DataFrame, path: str, material: list[str] | None = None) -> DataFrame:
    """Run a stream of observations over everything available; all changes found so far.

    The last known value of each field is kept in a bucketed table, of which a
    batch reads and replaces only the buckets of its own fields; its changes
    are written below the number of the batch. A repeated batch sees what the
    first try saw and replaces what that wrote.
    """
    spark = observations.sparkSession
    state = BucketTable(spark, f"{path}/known", FIELD, KNOWN_SCHEMA)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        keys = batch.select(*FIELD, F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("at")).distinct()
        _, known = state.touched(keys, batch_id)
        changed, latest = changes_of_batch(batch, known)
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        state.upsert(latest, batch_id)

    seen = observed_fields(observations, material)
    query = seen.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(CHANGE_SCHEMA).parquet(f"{path}/changes/*")


def upsert_to_table(stream: DataFrame, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Run an aggregation in update mode; a table with the last row of each key.

    A batch hands over the rows it changed, and only their buckets are written.
    """
    table = BucketTable(stream.sparkSession, f"{path}/table", keys, stream.schema, buckets)
    query = stream.writeStream.outputMode("update").foreachBatch(table.upsert).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def stream_health(executions: DataFrame) -> DataFrame:
    """One health row per execution; needs no state."""
    return executions.select("target", "provider", (F.col("status") == "OK").alias("ok"), "status", "at")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read the table it wrote.

    Each batch owns one folder named by its id, so a repeated batch replaces
    itself. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = "batch=0" if mode == "complete" else f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/rows/{folder}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows/*")
