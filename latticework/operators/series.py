"""Ordered series: numbering rows of few large groups without a task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut


def ordinals(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... in the order of `order` within each group of keys; equal ones in any order.

    Rows are dealt by ranges of (keys, order), so a large group lies in many partitions. Each numbers its
    own rows, and what the partitions before hold of a group, a row for each partition and group, is added.
    """
    dealt = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(W.partitionBy("_part", *keys).orderBy(order))
    counts = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before"))
    on = [dealt["_part"] == F.col("_p"), *[dealt[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return dealt.withColumn("_own", own).join(left, on).select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name))
