"""Streaming forms against batch results."""

import pytest
from pyspark.sql import functions as F

from fanloom.operators import compact
from fanloom.streaming import loops


def test_counts_and_ewma(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("t", k, (k % 3) + 1, float(100 * k)) for k in range(12)]
    df = spark.createDataFrame(rows, "type_key string, seq int, n int, m double")
    df.where("seq < 6").coalesce(1).write.parquet(src)
    df.where("seq >= 6").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(src)
    q = loops.ewma_stream(stream).writeStream.outputMode("update").format("memory").queryName("ewma").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from ewma").orderBy(F.desc("sample_count")).first()
    want = compact.weighted_ewma(df, "type_key", F.col("seq"), "n", "m").first()
    assert got.sample_count == want.sample_count and got.avg_ms == pytest.approx(want.avg_ms) and got.weight == pytest.approx(want.weight)


def test_loop_runs_a_tick_for_each_batch(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    ticks = []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    loops.run_loop(stream, ticks.append, f"{tmp_path}/c").awaitTermination(60)
    assert len(ticks) == 1


def test_poll_delay():
    assert loops.poll_delay(0.1, 128, 128) == 0.0 and loops.poll_delay(0.1, 5, 128) == 0.025
    assert loops.poll_delay(0.1, 0, 128) == 0.2 and loops.poll_delay(1.9, 0, 128) == 2.0


def test_loops_run_at_their_own_pace():
    from datetime import datetime, timedelta

    from fanloom.config import EngineOptions
    from fanloom.streaming import loops

    class Fake:
        options = EngineOptions(claim_batch=10)

        def __init__(self):
            self.calls, self.found = [], [10, 10, 3, 0, 0, 0, 0]

        def __getattr__(self, name):
            return lambda now: self.calls.append((name, now))

        def work(self, now):
            self.calls.append(("work", now))
            return (self.found.pop(0), 0)

    engine, times, slept = Fake(), [datetime(2024, 1, 1)], []

    def sleep(seconds):
        slept.append(seconds)
        times.append(times[-1] + timedelta(seconds=1))

    loops.run_engine(engine, lambda: times[-1], sleep, lambda: bool(engine.found))
    assert slept == [0.0, 0.0, 0.025, 0.05, 0.1, 0.2, 0.4]
    count = lambda name: sum(n == name for n, _ in engine.calls)
    assert (count("work"), count("recover"), count("refresh"), count("reconcile"), count("compact"), count("purge")) == (7, 1, 4, 4, 2, 1)
