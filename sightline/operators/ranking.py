"""Global order without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.components import cut


def global_rank(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with its rows' numbers in this order: sorted by range, numbered in each partition, shifted by
    the counts of the partitions before (one number for each goes through a window)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_no", F.spark_partition_id())
    own = cut(ordered.withColumn("row_no", F.row_number().over(Window.partitionBy("part_no").orderBy(*order))), "numbered")  # read twice
    sizes = own.groupBy("part_no").agg(F.count("*").alias("n"))
    before = sizes.withColumn("shift", F.sum("n").over(Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(F.broadcast(before.select("part_no", F.coalesce("shift", F.lit(0)).alias("shift"))), "part_no").withColumn(
        name, (F.col("row_no") + F.col("shift") - 1 + start).cast("bigint")
    ).drop("part_no", "row_no", "shift")
