"""Pausing and resuming task types, and the bounded passes that move their tasks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.operators.claim import ORDER
from fanloom.operators.stamp import bases


def flip(schedule: DataFrame, key: str, state: str) -> DataFrame:
    """The schedule with the type's pause state set; a row of inherited values is made where there is none."""
    spark = schedule.sparkSession
    new = spark.createDataFrame([(key,)], "type_key string").withColumn("new_state", F.lit(state))
    joined = schedule.join(new, "type_key", "full_outer")
    return joined.select("type_key", "batch_size", "gap_seconds", "max_attempts", F.coalesce("new_state", "pause_state").alias("pause_state"))


def pause(schedule: DataFrame, key: str) -> DataFrame:
    return flip(schedule, key, "paused")


def resume(schedule: DataFrame, key: str, rebase: bool = True) -> DataFrame:
    """Resumes a paused type; its tasks get new keys with ``rebase``. A type that isn't paused stays as it is."""
    moved = F.lit("resuming_rebase" if rebase else "resuming_asis")
    mine = (F.col("type_key") == key) & (F.col("pause_state") == "paused")
    return schedule.withColumn("pause_state", F.when(mine, moved).otherwise(F.col("pause_state")))


def candidates(tasks: DataFrame, schedule: DataFrame) -> DataFrame:
    """Tasks that are to move, with ``direction``: waiting ones of paused types, paused ones of types that resume."""
    kinds = schedule.where(F.col("pause_state") != "active").select("type_key", "pause_state")
    moving = tasks.join(kinds, "type_key")
    out = (F.col("pause_state") == "paused") & (F.col("state") == S.PENDING)
    back = F.col("pause_state").startswith("resuming") & (F.col("state") == S.PAUSED)
    return moving.where(out | back).withColumn("direction", F.when(out, "pause").otherwise("resume"))


def select_moves(tasks: DataFrame, schedule: DataFrame, chunk: int = 10_000, budget: int = 200_000) -> DataFrame:
    """The tasks that one pass moves, with ``r``, their place within the type.

    The budget is halved if both directions have work, and split evenly over the types of a direction (one row at
    least). A type is moved in chunks, and the budget is looked at before each: the last chunk may go over it."""
    found = candidates(tasks, schedule)
    work = found.groupBy("direction", "type_key").agg(F.count(F.lit(1)).alias("n"))
    types = work.groupBy("direction").agg(F.count(F.lit(1)).alias("types"))
    sides = types.agg(F.count(F.lit(1)).alias("sides"))
    share = F.greatest(F.lit(1), F.floor(F.floor(F.lit(budget) / F.col("sides")) / F.col("types")))
    slices = types.join(F.broadcast(sides)).select("direction", (F.ceil(share / chunk) * chunk).cast("bigint").alias("slice"))
    r = F.row_number().over(Window.partitionBy("type_key").orderBy(*ORDER))
    most = -(-max(budget, 1) // chunk) * chunk  # no slice is longer, so each partition sorts and sends that many at most
    return found.withColumn("r", r).where(F.col("r") <= most).join(F.broadcast(slices), "direction").where(F.col("r") <= F.col("slice")).drop("slice")


def reconcile(tasks: DataFrame, schedule: DataFrame, now: datetime, chunk: int = 10_000, budget: int = 200_000) -> DataFrame:
    """The moved tasks in their new state, and with new keys where the type is rebased: chunk after chunk from the tail
    of the type's waiting tasks of all jobs, or from the frontier."""
    moves = select_moves(tasks, schedule, chunk, budget)
    base = bases(tasks.where(F.col("state") == S.PAUSED), tasks, schedule, now, within_job=False).select("type_key", "base", "batch_size", "gap_seconds")
    rows = moves.join(base, "type_key", "left")
    c, k = F.floor((F.col("r") - 1) / chunk), (F.col("r") - 1) % chunk
    span = (F.floor((chunk - 1) / F.col("batch_size")) + 1) * F.col("gap_seconds")
    key = F.col("base") + c * span + F.floor(k / F.col("batch_size")) * F.col("gap_seconds")
    return rows.withColumns(
        {
            "state": F.when(F.col("direction") == "pause", S.PAUSED).otherwise(S.PENDING),
            "schedule_order": F.when(F.col("pause_state") == "resuming_rebase", key).otherwise(F.col("schedule_order")),
        }
    ).drop("base", "batch_size", "gap_seconds", "r", "direction", "pause_state")


def activated(schedule: DataFrame, tasks: DataFrame) -> DataFrame:
    """The schedule with types active that resumed and have no paused task left."""
    left = tasks.where(F.col("state") == S.PAUSED).select("type_key").distinct().withColumn("left", F.lit(True))
    done = F.col("pause_state").startswith("resuming") & F.col("left").isNull()
    return schedule.join(left, "type_key", "left").withColumn("pause_state", F.when(done, "active").otherwise(F.col("pause_state"))).drop("left")
