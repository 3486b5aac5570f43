"""Claiming: the waiting tasks of least order key, skipping paused types."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.operators.stamp import with_schedule

ORDER = ("schedule_order", "created_at", "task_index", "id")


def eligible(tasks: DataFrame, schedule: DataFrame, now: datetime) -> DataFrame:
    """Waiting tasks that are due and whose type isn't paused."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now))
    paused = schedule.where(F.col("pause_state") == "paused").select("type_key")
    return tasks.where((F.col("state") == S.PENDING) & due).join(paused, "type_key", "left_anti")


def claim(tasks: DataFrame, schedule: DataFrame, now: datetime, limit: int, owner: str) -> DataFrame:
    """The ``limit`` first eligible tasks, as running attempts of ``owner`` (a limit under 0 counts as 0)."""
    first = eligible(tasks, schedule, now).orderBy(*ORDER).limit(max(0, limit))
    return first.withColumns({"state": F.lit(S.RUNNING), "attempt": F.col("attempt") + 1, "claimed_by": F.lit(owner), "claimed_at": F.lit(now)})


def with_context(claimed: DataFrame, jobs: DataFrame, schedule: DataFrame) -> DataFrame:
    """Claimed tasks with the shared payload of their job and the schedule of their type."""
    shared = jobs.select(F.col("id").alias("job_id"), F.col("payload").alias("job_payload"), F.col("type").alias("job_type"))
    return with_schedule(claimed.join(shared, "job_id"), schedule)


def claim_for(tasks: DataFrame, schedule: DataFrame, now: datetime, limit: int, owners: list[str]) -> DataFrame:
    """Disjoint claims of several owners in one pass: the first tasks go to them in turn."""
    first = eligible(tasks, schedule, now).orderBy(*ORDER).limit(max(0, limit) * len(owners))
    turn = F.row_number().over(Window.orderBy(*ORDER)) - 1  # over limit * owners rows at most
    names = F.array(*[F.lit(o) for o in owners])
    out = first.withColumn("claimed_by", F.element_at(names, (turn % len(owners) + 1).cast("int")))
    return out.withColumns({"state": F.lit(S.RUNNING), "attempt": F.col("attempt") + 1, "claimed_at": F.lit(now)})


def beat(heartbeats: DataFrame, beats: DataFrame) -> DataFrame:
    """Heartbeats with newer ones taken in, one row an instance."""
    both = heartbeats.unionByName(beats)
    return both.groupBy("instance_id").agg(F.max("last_seen_at").alias("last_seen_at"), F.max_by("executing", F.struct("last_seen_at", "executing")).alias("executing"))


def poll(tasks: DataFrame, jobs: DataFrame, schedule: DataFrame, heartbeats: DataFrame, now: datetime, limit: int, owner: str, executing: int = 0):
    """(claimed with context, heartbeats): a beat is made whatever the limit."""
    spark = tasks.sparkSession
    own = spark.createDataFrame([(owner, now, executing)], S.HEARTBEAT)
    return with_context(claim(tasks, schedule, now, limit, owner), jobs, schedule), beat(heartbeats, own)
