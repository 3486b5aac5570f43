"""Tables of the engine (as DDL), states and defaults.

A *job* is one business event, a *task* one unit of its fan-out, an *attempt* one execution of a task. All tables are
plain DataFrames; ``store.SnapshotStore`` keeps them as versioned Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_KEY = "__default__"
DEFAULT_BATCH, DEFAULT_GAP, DEFAULT_ATTEMPTS = 1000, 1.0, 5

PENDING, RUNNING, SUCCEEDED, FAILED, PAUSED = "Pending", "Running", "Succeeded", "Failed", "Paused"
ACTIVE, COMPLETED, FAULTED = "Active", "Completed", "Faulted"
ABANDONED = "Abandoned"
HOT = (PENDING, RUNNING, PAUSED)


ITEM = "struct<outcome:string,output:string,targetIds:array<string>>"
JOB = (
    "id string, name string, type string, payload string, payload_type string, status string, task_count bigint, pending bigint, running bigint, "
    "paused bigint, failed bigint, retry_count bigint, refreshed_at timestamp, created_at timestamp, completed_at timestamp, compacted_at timestamp, "
    "expire_at timestamp, avg_duration_ms bigint, attempt_sample_count bigint"
)
TASK = (
    "id string, job_id string, parent_task_id string, task_index bigint, payload string, payload_type string, type_key string, state string, attempt int, "
    "claimed_by string, next_attempt_at timestamp, created_at timestamp, claimed_at timestamp, completed_at timestamp, schedule_order double"
)
ATTEMPT = (
    f"id string, task_id string, job_id string, attempt int, claimed_at timestamp, started_at timestamp, ended_at timestamp, outcome string, duration_ms bigint, report array<{ITEM}>"
)
HEARTBEAT = ("instance_id string, last_seen_at timestamp, executing int")
SCHEDULE = ("type_key string, batch_size int, gap_seconds double, max_attempts int, pause_state string")
METRIC = ("type_key string, sample_count bigint, weight double, avg_ms double, avg_wait_ms double, avg_retry_rate double")
CHUNK = (f"job_id string, chunk_index int, items array<{ITEM}>, target_count int, created_at timestamp")
TABLES = {"job": JOB, "task": TASK, "attempt": ATTEMPT, "heartbeat": HEARTBEAT, "schedule": SCHEDULE, "metric": METRIC, "chunk": CHUNK}


def type_key(job_type: Column, task_type: Column) -> Column:
    """``job|task``, a null part as nothing."""
    return F.concat(F.coalesce(job_type, F.lit("")), F.lit("|"), F.coalesce(task_type, F.lit("")))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp, with or without time zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
