"""Ordinal numbers over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.session import stored

# monotonically_increasing_id keeps the row index in its low 33 bits.
INDEX_BITS = 33


def number_rows(df: DataFrame, order_by: list[Column], out: str = "row_no", is_stored: bool = False) -> DataFrame:
    """1..n in the given total order (the keys must be unique).

    Range partitioning sorts in parallel; only one count per partition is
    brought together to find the offsets. The input is stored first, because
    range partitioning samples it in a pass of its own (``is_stored``: it is a
    plain selection from a stored table), and the sorted rows are stored as
    well, so a lost executor cannot renumber them.
    """
    ordered = (df if is_stored else stored(df)).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stored(ordered.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", INDEX_BITS)
    index = F.col("_pos").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition of a sort: bounded by the partition count
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_offset") + index + 1).drop("_part", "_pos", "_offset")


def number_within(df: DataFrame, group: list[str], order_by: list[Column], out: str = "row_no") -> DataFrame:
    """1..n inside each group, also when one group holds most rows."""
    numbered = number_rows(df, [F.col(g) for g in group] + order_by, "_global")
    first = numbered.groupBy(*group).agg(F.min("_global").alias("_first"))
    return numbered.join(first, group).withColumn(out, F.col("_global") - F.col("_first") + 1).drop("_global", "_first")


def ordinal_id(prefix: str, number: Column, width: int = 4) -> Column:
    """Zero-padded id that is never cut when the number outgrows the width."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def spread(df: DataFrame, group: list[str], order_by: list[str]) -> DataFrame:
    """``df`` sorted over range partitions, with the partition of each row (_part); a large group fills several."""
    keys = [*group, *order_by]
    ordered = stored(df).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("_part", F.spark_partition_id()))


def _with_carried(rows: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` beside what earlier partitions hand over; one row for each partition that a group reaches."""
    named = carried.select(*[F.col(c).alias(f"_c_{c}") for c in ["_part", *group]], "_carried")
    on = F.col("_part") == F.col("_c__part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    return rows.join(named, on).drop(*[f"_c_{c}" for c in ["_part", *group]])


def lag_within(df: DataFrame, group: list[str], order_by: list[str], value: str, out: str) -> DataFrame:
    """``value`` of the row before, also when one group holds most rows.

    Windows stay inside range partitions; only the last value of a group in
    each partition is handed to the next one. The order must be total.
    """
    placed = spread(df, group, order_by)
    near = W.partitionBy("_part", *group).orderBy(*order_by)
    rows = placed.withColumns({out: F.lag(value).over(near), "_first": F.row_number().over(near) == 1})
    last = placed.groupBy("_part", *group).agg(F.max_by(F.struct(value), F.struct(*order_by)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*group).orderBy("_part")))
    joined = _with_carried(rows, carried, group)
    return joined.withColumn(out, F.when(F.col("_first"), F.col(f"_carried.{value}")).otherwise(F.col(out))).drop("_first", "_carried", "_part")


def sum_before(placed: DataFrame, group: list[str], order_by: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, 0 for the first; ``placed`` comes from ``spread``."""
    before = [W.unboundedPreceding, -1]
    near = W.partitionBy("_part", *group).orderBy(*order_by).rowsBetween(*before)
    rows = placed.withColumn(out, F.coalesce(F.sum(value).over(near), F.lit(0)))
    total = placed.groupBy("_part", *group).agg(F.sum(value).alias("_total"))
    carried = total.withColumn("_carried", F.coalesce(F.sum("_total").over(W.partitionBy(*group).orderBy("_part").rowsBetween(*before)), F.lit(0)))
    return _with_carried(rows, carried, group).withColumn(out, F.col(out) + F.col("_carried")).drop("_carried")


def sum_before_within(df: DataFrame, group: list[str], order_by: list[str], value: str, out: str) -> DataFrame:
    """``sum_before`` of rows that are not spread yet; also when one group holds most rows."""
    return sum_before(spread(df, group, order_by), group, order_by, value, out).drop("_part")
