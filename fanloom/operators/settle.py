"""Settlement of attempts, behind a fence: only the attempt that runs, of the owner that runs it, can settle a task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom import schema as S
from fanloom.functions.scalars import after, backoff_ms, duration_ms
from fanloom.operators.stamp import initial_state, with_schedule


def once(outcomes: DataFrame) -> DataFrame:
    """One outcome of each attempt (task_id, attempt): that which ended first, of those a success before a failure, then
    the one that started first, then the least by the other columns."""
    first = [c for c in ("ended_at", "failed", "started_at") if c in outcomes.columns]
    rest = [c for c in outcomes.columns if c not in ("task_id", "attempt", *first)]
    found = outcomes.groupBy("task_id", "attempt").agg(F.min(F.struct(*first, *rest)).alias("o"))
    return found.select("task_id", "attempt", "o.*").select(*outcomes.columns)


def fenced(tasks: DataFrame, outcomes: DataFrame, owner: str | None = None) -> DataFrame:
    """Outcomes (task_id, attempt, ...) joined to the running tasks they belong to; superseded ones are left out, and
    of several outcomes of one attempt one counts (``once``). A batch that holds successes and failures is to go through
    ``once`` before it is split, so that an attempt can't do both."""
    mine = F.col("state") == S.RUNNING
    if owner is not None:
        mine &= F.col("claimed_by") == owner
    return tasks.where(mine).join(once(outcomes).withColumnRenamed("task_id", "id"), ["id", "attempt"])


def settled(tasks: DataFrame, outcomes: DataFrame, schedule: DataFrame, now: datetime, owner: str | None = None, base_ms: int = 2000, most_ms: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """(tasks that succeed, tasks whose attempt failed) of a batch of both; an attempt is in one of them at most."""
    chosen = once(outcomes)
    return complete(tasks, chosen.where(~F.col("failed")), now, owner), fail(tasks, chosen.where("failed"), schedule, now, owner, base_ms, most_ms)


def complete(tasks: DataFrame, outcomes: DataFrame, now: datetime, owner: str | None = None) -> DataFrame:
    """The tasks that succeed, in their new state, with started_at, ended_at and report of the outcome."""
    return fenced(tasks, outcomes, owner).withColumns({"state": F.lit(S.SUCCEEDED), "completed_at": F.lit(now), "next_attempt_at": F.lit(None).cast("timestamp")})


def fail(tasks: DataFrame, outcomes: DataFrame, schedule: DataFrame, now: datetime, owner: str | None = None, base_ms: int = 2000, most_ms: int = 300_000) -> DataFrame:
    """The tasks whose attempt failed: failed for good at the last attempt, else waiting (or paused) with a delay; the
    order key stays."""
    rows = with_schedule(fenced(tasks, outcomes, owner), schedule)
    last = F.col("attempt") >= F.col("max_attempts")
    retry = after(F.col("ended_at"), backoff_ms(F.col("attempt"), base_ms, most_ms) / 1000)
    return rows.withColumns(
        {
            "state": F.when(last, S.FAILED).otherwise(initial_state(F.col("pause_state"))),
            "completed_at": F.when(last, F.lit(now)),
            "next_attempt_at": F.when(~last, retry),
            "claimed_by": F.when(last, F.col("claimed_by")),
        }
    )


def attempts(moved: DataFrame, outcome: str) -> DataFrame:
    """Audit rows of settled tasks (with started_at, ended_at, report)."""
    return moved.select(
        F.concat_ws("#", "id", F.col("attempt").cast("string")).alias("id"), F.col("id").alias("task_id"), "job_id", "attempt", "claimed_at", "started_at", "ended_at",
        F.lit(outcome).alias("outcome"), duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"), "report",
    )


def merged(tasks: DataFrame, moved: DataFrame) -> DataFrame:
    """The table with the rows of ``moved`` in place of those of the same id."""
    return tasks.join(moved.select("id"), "id", "left_anti").unionByName(moved.select(*tasks.columns))
