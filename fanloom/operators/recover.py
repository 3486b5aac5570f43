"""Recovery of tasks whose worker is gone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom import schema as S
from fanloom.operators.stamp import initial_state, with_schedule


def dead(heartbeats: DataFrame, now: datetime, stale: timedelta, me: str) -> DataFrame:
    """Instances not seen for so long, but oneself."""
    return heartbeats.where((F.col("last_seen_at") < F.lit(now - stale)) & (F.col("instance_id") != me))


def released(stranded: DataFrame, schedule: DataFrame, now: datetime) -> DataFrame:
    """Stranded tasks in their new state: failed if that was the last attempt, else waiting or paused again."""
    rows = with_schedule(stranded, schedule)
    poison = F.col("attempt") >= F.col("max_attempts")
    return rows.withColumns({"state": F.when(poison, S.FAILED).otherwise(initial_state(F.col("pause_state"))), "claimed_by": F.lit(None).cast("string"), "completed_at": F.when(poison, F.lit(now))})


def stale(tasks: DataFrame, heartbeats: DataFrame, schedule: DataFrame, now: datetime, threshold: timedelta, me: str):
    """(released tasks, heartbeats that stay)."""
    gone = dead(heartbeats, now, threshold, me).select("instance_id")
    running = tasks.where(F.col("state") == S.RUNNING).join(gone.withColumnRenamed("instance_id", "claimed_by"), "claimed_by", "left_semi")
    return released(running, schedule, now), heartbeats.join(gone, "instance_id", "left_anti")


def self_stranded(tasks: DataFrame, schedule: DataFrame, now: datetime, grace: timedelta, me: str, keep: DataFrame) -> DataFrame:
    """One's own running tasks, claimed long ago, that one doesn't hold (``keep``: ids)."""
    mine = tasks.where((F.col("state") == S.RUNNING) & (F.col("claimed_by") == me) & (F.col("claimed_at") < F.lit(now - grace)))
    return released(mine.join(keep.select("id"), "id", "left_anti"), schedule, now)


def remove_instance(heartbeats: DataFrame, tasks: DataFrame, instance: str) -> DataFrame:
    """Heartbeats without the instance's, unless it still runs tasks."""
    busy = tasks.where(F.col("state") == S.RUNNING).select(F.col("claimed_by").alias("instance_id")).distinct()
    gone = heartbeats.where(F.col("instance_id") == instance).join(busy, "instance_id", "left_anti").select("instance_id")
    return heartbeats.join(gone, "instance_id", "left_anti")


def abandoned(released_tasks: DataFrame, now: datetime) -> DataFrame:
    """Audit rows of the attempts that were given up."""
    item = F.struct(F.lit(S.ABANDONED).alias("outcome"), F.lit("worker lost").alias("output"), F.array().cast("array<string>").alias("targetIds"))
    return released_tasks.select(
        F.concat_ws("#", "id", F.col("attempt").cast("string")).alias("id"), F.col("id").alias("task_id"), "job_id", "attempt", "claimed_at", F.col("claimed_at").alias("started_at"),
        F.lit(now).alias("ended_at"), F.lit(S.ABANDONED).alias("outcome"), F.lit(None).cast("bigint").alias("duration_ms"), F.array(item).alias("report"),
    )
