"""Fan-out: rows of a source become task payloads, lazily and without leaving the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.operators.rowindex import with_row_index

KEEP_NULLS = {"ignoreNullFields": "false"}


def payload(*columns: str | Column) -> Column:
    """One JSON object; null fields stay."""
    return F.to_json(F.struct(*columns), KEEP_NULLS)


def one_to_one(source: DataFrame, where: Column | str | None, *fields: str | Column, targets: Column | None = None) -> DataFrame:
    """(payload, targets?) for each row that ``where`` keeps; with no fields, the whole row is the payload."""
    rows = source if where is None else source.where(where)
    out = [payload(*(fields or [F.col(c) for c in source.columns])).alias("payload")]
    return rows.select(*out, *([targets.alias("targets")] if targets is not None else []))


def batched(source: DataFrame, where: Column | str | None, item: Column, into: str, size: int, *order: Column | str) -> DataFrame:
    """(batch, payload): ``{into: [items]}`` of ``size`` items in the given total order, the last may be short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    rows = source if where is None else source.where(where)
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    items = rows.select(item.alias("v"), *[c.alias(f"o{k}") for k, c in enumerate(by)])
    indexed = with_row_index(items, *[F.col(f"o{k}") for k in range(len(by))])
    groups = indexed.groupBy(F.floor(F.col("k") / size).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return groups.select("batch", F.to_json(F.struct(F.col("kv.v").alias(into)), KEEP_NULLS).alias("payload"))


def raw_sql(spark, sql: str, **views: DataFrame) -> DataFrame:
    """(payload): the only column of a query is the payload of a task; one last semicolon is allowed."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise ValueError("the query is blank")
    rows = spark.sql(text, **views) if views else spark.sql(text)
    if len(rows.columns) != 1:
        raise ValueError("the query must have one column")
    return rows.toDF("payload")


def expand(parents: DataFrame, children: DataFrame, on: list[str], *fields: str | Column) -> DataFrame:
    """(job_id, parent_task_id, payload) of child tasks of tasks that run; ``parents`` has job_id, id, state and the
    keys of ``children``. Tasks in any other state may not expand."""
    own = parents.where(F.col("state") == "Running").withColumnRenamed("id", "parent_task_id")
    return own.join(children, on).select("job_id", "parent_task_id", payload(*fields).alias("payload"))
