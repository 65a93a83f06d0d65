"""Running totals and row numbers over groups of any size.

A group with a third of all rows would be one task's sort in a plain window. Here rows are range-partitioned by group and order, so such
a group lies in many partitions; each part is summed on its own, and the parts' totals (one row a group and partition) are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.session import cut, partitions


def running_total(df: DataFrame, by: list[str], order: list[str | Column], value: Column, out: str) -> DataFrame:
    """``out``: inclusive running total of ``value`` in each group ``by`` (nulls are a group), in ``order``, which should tell rows apart.

    Null values count as nothing; a group of nulls only has null totals, as in SQL. An empty table gives no rows.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    # Rows are written once with the number of their range, which sampling might draw otherwise another time.
    placed = df.withColumn("_value", value).repartitionByRange(partitions(df.sparkSession), *by, *keys).withColumn("_part", F.spark_partition_id())
    placed = cut(placed, "ranges")
    inside = Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum("_value").over(inside))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges only
    totals = placed.groupBy(*by, "_part").agg(F.sum("_value").alias("_total")).withColumn("_before", F.sum("_total").over(before))
    condition = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    joined = local.alias("l").join(totals.alias("r"), condition)
    total = F.when(F.col("l._local").isNull(), F.col("r._before")).otherwise(F.col("l._local") + F.coalesce("r._before", F.lit(0)))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns if c != out), total.alias(out))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``out``: 1, 2, 3 ... in each group ``by``, in ``order``."""
    return running_total(df, by, order, F.lit(1).cast("bigint"), out)
