"""Refreshing the counts of active jobs from their tasks, and their completion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom import schema as S


def counts(tasks: DataFrame) -> DataFrame:
    """One conditional aggregate over the tasks: (job_id, pending, running, paused, failed)."""
    return tasks.groupBy("job_id").agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in (S.PENDING, S.RUNNING, S.PAUSED, S.FAILED)])


def refresh(jobs: DataFrame, tasks: DataFrame, now: datetime, attempts: DataFrame | None = None) -> DataFrame:
    """``jobs`` (id, status, task_count, completed_at, ...) with the active ones recounted.

    A job is done when it has tasks and none waits, runs or is paused: faulted if any failed for good, else completed."""
    active = jobs.where(F.col("status") == S.ACTIVE)
    found = counts(tasks.join(active.select(F.col("id").alias("job_id")), "job_id", "left_semi"))
    names = ["pending", "running", "paused", "failed"]
    rows = active.drop(*names, *(["retry_count"] if attempts is not None else [])).join(found.withColumnRenamed("job_id", "id"), "id", "left").fillna(0, names)
    if attempts is not None:
        retries = attempts.where("attempt > 1").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("retry_count"))
        rows = rows.join(retries, "id", "left").fillna(0, ["retry_count"])
    done = (F.col("task_count") > 0) & (F.col("pending") + F.col("running") + F.col("paused") == 0)
    rows = rows.withColumns(
        {
            "status": F.when(done & (F.col("failed") > 0), S.FAULTED).when(done, S.COMPLETED).otherwise(S.ACTIVE),
            "completed_at": F.when(done, F.lit(now)).otherwise(F.col("completed_at")),
            "refreshed_at": F.lit(now),
        }
    )
    return jobs.where(F.col("status") != S.ACTIVE).unionByName(rows.select(*jobs.columns))
