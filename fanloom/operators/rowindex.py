"""A dense row number over a whole DataFrame without moving it into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom.session import fresh, materialise


def with_row_index(df: DataFrame, *order: Column, name: str = "k", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the rank from 0 in the total order given.

    Rows are range-partitioned and written once (range bounds come from a sample and may differ between two runs of the
    same plan), numbered within each partition, and shifted by the counts of the partitions before. Only those counts,
    one row a partition, are broadcast."""
    part, rank, base = fresh(df.columns + [name], "part", "rank", "base")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(base))
    before = F.coalesce(F.sum(base).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(part, before.alias(base))
    numbered = ranged.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return numbered.join(F.broadcast(shifts), part).withColumn(name, (F.col(rank) + F.col(base)).cast("bigint")).drop(part, rank, base)
