"""Streaming forms: the loops as micro-batches, running counts, and moving averages with state."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fanloom.operators.compact import DECAY


def run_loop(ticks: DataFrame, tick: Callable[[datetime], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Runs a tick of the engine for each micro-batch of a stream (a rate or file source): the next begins after the last
    has committed. Without ``seconds``, what is there is worked off and the query ends."""

    def batch(df: DataFrame, epoch: int) -> None:
        tick(datetime.now(timezone.utc).replace(tzinfo=None))

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def poll_delay(last: float, claimed: int, limit: int, least: float = 0.025, most: float = 2.0) -> float:
    """Seconds to wait before the next poll: none after a full claim, else twice the last wait within bounds."""
    if limit > 0 and claimed >= limit:
        return 0.0
    if claimed > 0:
        return least
    return min(most, max(least, last * 2))


def running_counts(tasks: DataFrame) -> DataFrame:
    """Counts of tasks by job and state of a stream of task rows (update mode)."""
    return tasks.groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("tasks"))


def windowed_outcomes(attempts: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Attempts by window and outcome, with a bound on lateness."""
    timed = attempts.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("attempts")).select(F.col("w.start").alias("start"), "outcome", "attempts")


def ewma_stream(jobs: DataFrame) -> DataFrame:
    """(type_key, avg_ms, weight, sample_count) of a stream of finished jobs (type_key, seq, n, m), folded in the order of
    ``seq`` within a batch, with state across batches."""

    def fold(key: tuple, frames, state: GroupState):
        avg, weight, count = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for n, m in zip(rows["n"], rows["m"]):
            decayed = weight * DECAY
            avg = (decayed * avg + n * m) / (decayed + n)
            weight = decayed + n
            count += int(n)
        state.update((float(avg), float(weight), int(count)))
        yield pd.DataFrame({"type_key": [key[0]], "avg_ms": [avg], "weight": [weight], "sample_count": [count]})

    return jobs.groupBy("type_key").applyInPandasWithState(
        fold, "type_key string, avg_ms double, weight double, sample_count bigint", "avg double, weight double, n bigint", "update", GroupStateTimeout.NoTimeout
    )


def duration_histogram(attempts: DataFrame, bounds: list[int]) -> DataFrame:
    """Attempts by type and bucket: bucket k holds durations from the k-th bound on (0: under the first)."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col("duration_ms") >= b).cast("int")
    return attempts.groupBy("type_key", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("attempts"))


def run_engine(engine, clock: Callable[[], datetime], sleep: Callable[[float], None], going: Callable[[], bool]) -> None:
    """Runs an engine's loops, each at its own pace, in one driver: recovery, reconciling, refreshing, compaction and
    purging when their interval is over, and work whenever the last poll's delay is (at once after a full claim, else
    twice as late each time nothing is found)."""
    o = engine.options
    every = {"recover": o.recover_every, "reconcile": o.reconcile_every, "refresh": o.refresh_every, "compact": o.compact_every, "purge": o.purge_every}
    last: dict[str, datetime] = {}
    delay = 0.0
    while going():
        now = clock()
        for name, seconds in every.items():
            if name not in last or (now - last[name]).total_seconds() >= seconds:
                last[name] = now
                getattr(engine, name)(now)
        done = sum(engine.work(now))
        delay = poll_delay(delay, done, o.claim_batch)
        sleep(delay)


def event_metrics(claimed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counters by type: claimed, succeeded, failed and the mean duration."""
    done = outcomes.groupBy("type_key").agg(F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"), F.avg("duration_ms").alias("mean_ms"))
    return claimed.groupBy("type_key").agg(F.count(F.lit(1)).alias("claimed")).join(done, "type_key", "full_outer")
