"""Order keys and initial states of new tasks.

A task's key is the base of its type plus a slot's distance: ``base + (k div batch) * gap``. The base goes on after the
tasks of the same job and type that wait (their last key and a gap), and else starts at the frontier: the present, or
the first waiting key of all tasks if that is later. The base is computed once a type, from two small aggregates.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.functions.scalars import slot_order


def with_schedule(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """``rows`` (with type_key) with batch_size, gap_seconds, max_attempts, each of its own row or the default's, and
    pause_state of the own row (``active`` without one)."""
    keys = ("batch_size", "gap_seconds", "max_attempts")
    own = schedule.where(F.col("type_key") != S.DEFAULT_KEY).select("type_key", *[F.col(k).alias(f"own_{k}") for k in keys], F.col("pause_state").alias("own_pause"))
    default = schedule.where(F.col("type_key") == S.DEFAULT_KEY).select(*[F.col(k).alias(f"all_{k}") for k in keys])
    joined = rows.drop(*keys, "pause_state").join(own, "type_key", "left").join(F.broadcast(default), how="left")
    for k in keys:
        joined = joined.withColumn(k, F.coalesce(f"own_{k}", f"all_{k}"))
    return joined.withColumn("pause_state", F.coalesce("own_pause", F.lit("active"))).drop("own_pause", *[f"{p}_{k}" for p in ("own", "all") for k in keys])


def initial_state(pause_state: Column) -> Column:
    """Paused only while the own row of the type is paused; types that resume count as active."""
    return F.when(pause_state == "paused", S.PAUSED).otherwise(S.PENDING)


def frontier(existing: DataFrame, now: datetime) -> DataFrame:
    """One row: the present in seconds, or the first waiting key if later."""
    first = F.min(F.when(F.col("state") == S.PENDING, F.col("schedule_order")))
    return existing.agg(F.greatest(S.seconds(F.lit(now)), first).alias("frontier"))


def bases(new: DataFrame, existing: DataFrame, schedule: DataFrame, now: datetime, within_job: bool = True) -> DataFrame:
    """(job_id, type_key, base, batch_size, gap_seconds, pause_state) of the kinds of ``new``.

    With ``within_job`` off, waiting tasks of any job count as the type's tail (as for a resumed type)."""
    keys = ["job_id", "type_key"] if within_job else ["type_key"]
    kinds = with_schedule(new.select(*keys).distinct(), schedule)
    tail = existing.where(F.col("state") == S.PENDING).groupBy(*keys).agg(F.max("schedule_order").alias("tail"))
    base = F.coalesce(F.col("tail") + F.col("gap_seconds"), F.col("frontier"))
    return (
        kinds.join(tail, keys, "left")
        .join(F.broadcast(frontier(existing, now)), how="left")
        .select(*keys, base.alias("base"), "batch_size", "gap_seconds", "pause_state")
    )


def stamp(new: DataFrame, existing: DataFrame, schedule: DataFrame, now: datetime, *order: str, index: str | None = None) -> DataFrame:
    """``new`` (job_id, type_key, ...) with schedule_order and state.

    ``order`` gives the total order within a job and type; ``index`` names a column that holds k already."""
    k = F.col(index) if index else F.row_number().over(Window.partitionBy("job_id", "type_key").orderBy(*order)) - 1
    # the numbered rows are partitioned by the join's keys already
    rows = new.withColumn("slot_k", k.cast("bigint")).join(bases(new, existing, schedule, now), ["job_id", "type_key"])
    return rows.withColumn("schedule_order", slot_order(F.col("base"), F.col("slot_k"), F.col("batch_size"), F.col("gap_seconds"))).withColumn(
        "state", initial_state(F.col("pause_state"))
    ).drop("slot_k", "base", "batch_size", "gap_seconds", "pause_state")


def next_base(base: float, count: int, batch: int, gap: float, paused: bool) -> float:
    """Where the next specification of the same job and type starts: tasks that wait extend the tail, paused ones don't."""
    return base if paused or count == 0 else base + ((count - 1) // batch) * gap + gap
