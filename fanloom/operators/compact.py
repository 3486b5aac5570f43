"""Compaction of finished jobs: report chunks, means, moving averages, retention and purge."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom.config import Retention
from fanloom.functions.scalars import after

DECAY, ALPHA = 0.8, 0.2


def exploded(attempts: DataFrame) -> DataFrame:
    """(job_id, outcome, output, target_id) of all report items; an item without targets is one row without target,
    attempts without report are left out."""
    items = attempts.select("job_id", F.explode("report").alias("item"))
    return items.select("job_id", "item.outcome", "item.output", F.explode_outer("item.targetIds").alias("target_id"))


def chunks(rows: DataFrame, size: int, *tie: str) -> DataFrame:
    """(job_id, chunk_index, items, target_count): each job's exploded rows in the order of outcome, output and target
    (nulls last), ``size`` rows a chunk, grouped again within it."""
    order = [F.col(c).asc_nulls_last() for c in ("outcome", "output", *(tie or ("target_id",)))]
    numbered = rows.withColumn("chunk_index", F.floor((F.row_number().over(Window.partitionBy("job_id").orderBy(*order)) - 1) / size).cast("int"))
    groups = numbered.groupBy("job_id", "chunk_index", "outcome", "output").agg(F.array_sort(F.collect_list("target_id")).alias("targetIds"))
    ranked = F.struct(F.col("outcome"), F.col("output").isNull().alias("none"), F.col("output"), F.col("targetIds"))
    out = groups.groupBy("job_id", "chunk_index").agg(F.array_sort(F.collect_list(ranked)).alias("ranked"), F.sum(F.size("targetIds")).cast("int").alias("target_count"))
    items = F.transform("ranked", lambda x: F.struct(x["outcome"].alias("outcome"), x["output"].alias("output"), x["targetIds"].alias("targetIds")))
    return out.select("job_id", "chunk_index", items.alias("items"), "target_count")


def read_report(chunk_table: DataFrame) -> DataFrame:
    """(job_id, chunk_index, pos, outcome, output, targetIds) of the chunks, flat."""
    return chunk_table.select("job_id", "chunk_index", F.posexplode("items").alias("pos", "item")).select("job_id", "chunk_index", "pos", "item.*")


def job_means(attempts: DataFrame) -> DataFrame:
    """(job_id, avg_duration_ms, sample_count) over attempts that succeeded."""
    ok = attempts.where("outcome = 'Succeeded'")
    return ok.groupBy("job_id").agg(F.round(F.avg("duration_ms")).cast("bigint").alias("avg_duration_ms"), F.count("duration_ms").alias("sample_count"))


def weighted_ewma(means: DataFrame, type_col: str, order: Column, n: str, mean: str, wait: str | None = None) -> DataFrame:
    """(type, avg_ms, weight, sample_count[, avg_wait_ms]): the fold ``w = 0.8 w + n``, ``a = (0.8 w a + n m) / w``
    over a type's jobs, as a weighted sum that can be aggregated in parts. Jobs without a wait keep the earlier mean
    of waits, while their weight still counts."""
    aged = means.withColumn("age", F.row_number().over(Window.partitionBy(type_col).orderBy(order.desc())) - 1)
    w = F.pow(F.lit(DECAY), F.col("age")) * F.col(n)
    aggs = [(F.sum(w * F.col(mean)) / F.sum(w)).alias("avg_ms"), F.sum(w).alias("weight"), F.sum(n).cast("bigint").alias("sample_count")]
    if wait is None:
        return aged.groupBy(type_col).agg(*aggs)
    steps = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), F.col(n).cast("double").alias("n"), F.col(wait).cast("double").alias("x"))))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("a"))

    def step(acc, x):
        w1 = acc["w"] * DECAY + x["n"]
        a1 = F.when(x["x"].isNull(), acc["a"]).when(acc["a"].isNull(), x["x"]).otherwise((acc["w"] * DECAY * acc["a"] + x["n"] * x["x"]) / w1)
        return F.struct(w1.alias("w"), a1.alias("a"))

    folded = aged.groupBy(type_col).agg(*aggs, steps.alias("steps"))
    return folded.withColumn("avg_wait_ms", F.aggregate("steps", start, step, lambda acc: acc["a"])).drop("steps")


def rate_ewma(means: DataFrame, type_col: str, order: Column, rate: str) -> DataFrame:
    """(type, avg_retry_rate): the first rate, then 0.8 of the old and 0.2 of the new one, in closed form."""
    by = Window.partitionBy(type_col)
    rows = means.withColumns({"i": F.row_number().over(by.orderBy(order)), "of": F.count(F.lit(1)).over(by)})
    first = F.pow(F.lit(1 - ALPHA), F.col("of") - 1) * F.col(rate)
    later = ALPHA * F.pow(F.lit(1 - ALPHA), F.col("of") - F.col("i")) * F.col(rate)
    return rows.groupBy(type_col).agg(F.sum(F.when(F.col("i") == 1, first).otherwise(later)).alias("avg_retry_rate"))


def merge_metric(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metric rows after one more job a type: (type_key, sample_count, weight, avg_ms, avg_wait_ms, avg_retry_rate) and
    (type_key, n, mean_ms, wait_ms, rate)."""
    j = old.join(new, "type_key", "full_outer")
    w0 = F.coalesce("weight", F.lit(0.0)) * DECAY
    n = F.coalesce("n", F.lit(0))
    w1 = F.when(F.col("n").isNull(), F.col("weight")).otherwise(w0 + n)

    def blend(a: str, x: str) -> Column:
        return F.when(F.col(x).isNull() | (n == 0), F.col(a)).when(F.col(a).isNull(), F.col(x)).otherwise((w0 * F.col(a) + n * F.col(x)) / F.nullif(w0 + n, F.lit(0.0)))

    rate = F.when(F.col("rate").isNull(), F.col("avg_retry_rate")).when(F.col("avg_retry_rate").isNull(), F.col("rate")).otherwise(F.col("avg_retry_rate") * (1 - ALPHA) + F.col("rate") * ALPHA)
    return j.select(
        "type_key", (F.coalesce("sample_count", F.lit(0)) + n).cast("bigint").alias("sample_count"), F.coalesce(w1, F.lit(0.0)).alias("weight"),
        blend("avg_ms", "mean_ms").alias("avg_ms"), blend("avg_wait_ms", "wait_ms").alias("avg_wait_ms"), rate.alias("avg_retry_rate"),
    )


def retry_rates(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(job_id, type_key, rate): retries for each task, tasks without attempts counted."""
    joined = tasks.select(F.col("id").alias("task_id"), "job_id", "type_key").join(attempts.select("task_id", "attempt"), "task_id", "left")
    return joined.groupBy("job_id", "type_key").agg((F.count_if(F.col("attempt") > 1) / F.count_distinct("task_id")).alias("rate"))


def expiry(jobs: DataFrame, retention: Retention) -> DataFrame:
    """``jobs`` with expire_at: completion and the type's retention; null while not complete, or kept for ever."""
    return jobs.withColumn("expire_at", after(F.col("completed_at"), retention.column(F.col("type"))))


def ready(jobs: DataFrame, most: int) -> DataFrame:
    """Finished jobs to compact, those first that finished first."""
    done = jobs.where(F.col("status").isin("Completed", "Faulted") & F.col("compacted_at").isNull())
    return done.orderBy(F.col("completed_at").asc_nulls_last(), "id").limit(most)


def purgeable(jobs: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The jobs that expired, oldest first."""
    return jobs.where(F.col("expire_at") < F.lit(now)).orderBy("expire_at", "id").limit(limit)


def purge(jobs: DataFrame, chunk_table: DataFrame, now: datetime, limit: int) -> tuple[DataFrame, DataFrame]:
    """Jobs and chunks without the expired jobs."""
    gone = purgeable(jobs, now, limit).select("id")
    return jobs.join(gone, "id", "left_anti"), chunk_table.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")
