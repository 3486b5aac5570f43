"""Sources of fan-out: DataFrames, files, SQL text, databases, rows in memory, and generators of sample entities."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.functions.scalars import tax_code


def documents(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Nested documents from files."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def relational(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of ``key`` if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def sql(spark: SparkSession, text: str, **args: Any) -> DataFrame:
    """A query with bound parameters."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def rows(spark: SparkSession, items: Iterable[dict | tuple], schema: str) -> DataFrame:
    """Rows in memory with ``ord``, their place."""
    data = [({**x, "ord": k} if isinstance(x, dict) else (*x, k)) for k, x in enumerate(items)]
    return spark.createDataFrame(data, schema + ", ord bigint")


def unnested(spark: SparkSession, arrays: dict[str, list], schema: str) -> DataFrame:
    """Rows of parallel arrays of equal length."""
    if len({len(a) for a in arrays.values()}) > 1:
        raise ValueError("the arrays differ in length")
    return spark.createDataFrame(list(zip(*arrays.values())), schema)


def table_rows(df: DataFrame, key: str | None = None, value: Any = None, order: str | None = None) -> DataFrame:
    """A table's rows, of a key or all, in order."""
    out = df if key is None else df.where(F.col(key) == F.lit(value))
    return out.orderBy(order) if order else out


def seed_ranges(spark: SparkSession, total: int, batch: int) -> DataFrame:
    """(start_index, count): the numbers under ``total`` in batches."""
    if batch < 1 or total < 0:
        raise ValueError("batch must be at least 1 and total not negative")
    starts = spark.range(0, total, batch).withColumnRenamed("id", "start_index")
    return starts.withColumn("count", F.least(F.lit(batch), F.lit(total) - F.col("start_index")).cast("int"))


def entities(spark: SparkSession, total: int, size_kb: int = 10, seed: int = 42) -> DataFrame:
    """Sample entities with filings, as many as the size asks for: ceil((kb * 1024 - 900) / 1587), one at least."""
    filings = max(1, -(-(size_kb * 1024 - 900) // 1587))
    filing = F.transform(
        F.sequence(F.lit(1), F.lit(filings)),
        lambda k: F.struct((F.lit(2020) + k % 5).alias("year"), (k % 4 + 1).alias("quarter"), F.concat(F.lit("F-"), k.cast("string")).alias("referenceNumber"), (F.pmod(F.hash(F.col("id"), k), F.lit(100_000)) / 100).cast("decimal(18,2)").alias("grossRevenue")),
    )
    return spark.range(total).select(
        F.col("id").alias("index"), F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))).alias("id"), F.concat(F.lit("Company "), F.col("id").cast("string")).alias("name"),
        tax_code(F.col("id")).alias("taxCode"), (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(10_000_000)) / 100).cast("decimal(18,2)").alias("revenue"), F.pmod(F.hash(F.lit(seed), F.col("id")), F.lit(500)).alias("headcount"), filing.alias("filings"),
    )


def activity(spark: SparkSession, days: int = 365, seed: int = 1) -> DataFrame:
    """(day_index, total, failed): made activity."""
    n = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(15))
    return spark.range(days).select(F.col("id").alias("day_index"), n.alias("total"), F.when(n > 11, F.lit(1)).otherwise(0).alias("failed"))
