"""A keyed table in hash buckets, of which a write replaces only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from attestra.session import cut_lineage

Merge = Callable[[DataFrame], DataFrame]


def last_row(keys: list[str]) -> Merge:
    """The newest row of each key, whole."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("_bucket", "_new", *keys)]
        best = rows.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*rest), F.col("_new")).alias("_r"))
        return best.select("_bucket", *keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])

    return merge


class BucketTable:
    """Rows below ``path/rows/write=N/_bucket=B``; ``path/log`` tells which write a bucket is to be read from.

    Writes are numbered by their caller, such as with the id of a streaming
    batch. A write reads the buckets of its own keys as they stood before it,
    merges, and writes those buckets anew; the log gets its line last. A
    repeated write therefore replaces itself, and one that broke off is never
    read. Buckets that are not touched are neither read nor written.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        empty = spark.createDataFrame([], schema)
        self.schema = empty.withColumn("_bucket", F.lit(0)).schema
        self.columns = empty.columns

    def _live(self, before: int | None = None) -> dict[int, int]:
        """Bucket and the write to read it from; at most one entry for each bucket."""
        try:
            log = self.spark.read.schema("write long, bucket int").parquet(f"{self.path}/log")
            log = log if before is None else log.filter(F.col("write") < before)
            return {r.bucket: r.write for r in log.groupBy("bucket").agg(F.max("write").alias("write")).collect()}
        except AnalysisException:
            return {}

    def _rows(self, live: dict[int, int]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/rows/write={w}/_bucket={b}" for b, w in sorted(live.items())]
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*folders)
        return rows.select(*self.columns, "_bucket")

    def read(self) -> DataFrame:
        return self._rows(self._live()).drop("_bucket")

    def touched(self, rows: DataFrame, write: int) -> tuple[DataFrame, DataFrame]:
        """``rows`` with their bucket, and what the table held in these buckets before ``write``."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = cut_lineage(rows.select(*self.columns).withColumn("_bucket", bucket))
        wanted = {r[0] for r in placed.select("_bucket").distinct().collect()}
        return placed, self._rows({b: w for b, w in self._live(write).items() if b in wanted})

    def upsert(self, rows: DataFrame, write: int, merge: Merge | None = None) -> None:
        """Merge ``rows`` into their buckets; ``merge`` gets old rows (_new 0) and these (_new 1) with their _bucket."""
        placed, old = self.touched(rows, write)
        if placed.isEmpty():
            return
        both = old.withColumn("_new", F.lit(0)).unionByName(placed.withColumn("_new", F.lit(1)))
        merged = (merge or last_row(self.keys))(both).select(*self.columns, "_bucket")
        folder = f"{self.path}/rows/write={write}"
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        line = placed.select(F.lit(write).cast("long").alias("write"), F.col("_bucket").alias("bucket")).distinct()
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
