"""The engine end to end on a snapshot store, with the numbers of the rules."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fanloom import schema as S
from fanloom.config import DEFAULT_SCHEDULE, EngineOptions, Retention, TypeSchedule, schedules
from fanloom.engine import Engine
from fanloom.functions import scalars
from fanloom.handlers import Registry, Report
from fanloom.operators import compact, pause, stamp
from fanloom.operators.rowindex import with_row_index
from fanloom.store import Conflict, SnapshotStore

NOW = datetime(2024, 1, 1)


def at(seconds):
    return NOW + timedelta(seconds=seconds)


def test_lifecycle(spark, tmp_path):
    registry = Registry()

    def run(job, payload, ctx):
        if payload["id"] == "bad":
            raise ValueError("no") from KeyError("k")
        return Report().success(output="half") if payload["id"] == "x" else None

    registry.add_handler("tax", "calc", run, targets=lambda p: [p["id"]], batch_size=3, gap_seconds=10.0, max_attempts=2)
    e = Engine(spark, f"file://{tmp_path}/s", registry, EngineOptions("me", claim_batch=100), Retention(timedelta(days=1)))
    b = e.create("one", "tax", json.dumps({"rate": 1}))
    assert b.add_rows("calc", [json.dumps({"id": k}) for k in ("a", "b", "c", "d", "e", "x", "bad")]).dispatch(NOW) == 7
    slots = e.store.table("task").groupBy("schedule_order").count().orderBy("schedule_order").collect()
    assert [r[1] for r in slots] == [3, 3, 1] and slots[-1][0] - slots[0][0] == 20  # 7 tasks, batch 3, gap 10
    assert e.work(at(1)) == (6, 1)
    e.refresh(at(2))
    job = e.store.table("job").first()
    assert (job.status, job.pending, job.failed) == (S.ACTIVE, 1, 0)
    assert e.work(at(600)) == (0, 1)  # the last attempt
    e.refresh(at(601))
    job = e.store.table("job").first()
    assert (job.status, job.failed, job.retry_count) == (S.FAULTED, 1, 1)
    assert e.compact(at(700)) == 1
    report = [(r.outcome, r.output, r.targetIds) for r in e.report(job.id).collect()]
    assert ("Failed", "ValueError: no -> KeyError: 'k'", ["bad", "bad"]) in report  # retries stay
    assert e.store.table("task").count() == 0
    job = e.store.table("job").first()
    assert job.expire_at == at(601) + timedelta(days=1) and e.purge(at(700)) == 0
    assert e.purge(job.expire_at + timedelta(seconds=1)) == 1 and e.store.table("chunk").count() == 0
    e.store.vacuum(1)
    assert e.store.table("metric").count() == 1


def test_unknown_handler_and_column_handler(spark, tmp_path):
    registry = Registry()
    item = F.struct(F.lit("Succeeded").alias("outcome"), F.lit(None).cast("string").alias("output"), F.array(F.get_json_object("payload", "$.id")).alias("targetIds"))
    registry.add_handler("j", "fast", column=lambda df: F.array(item))
    e = Engine(spark, f"file://{tmp_path}/s", registry, EngineOptions("me"))
    e.create("n", "j").add_rows("fast", ['{"id":"1"}']).add_rows("none", ['{"id":"2"}']).dispatch(NOW)
    assert e.work(at(1)) == (1, 1)
    bad = e.store.table("attempt").where("outcome = 'Failed'").first()
    assert bad.report[0].output == "No handler registered for type key 'j|none'" and bad.report[0].targetIds == []


def test_born_complete_continue_and_conflict(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    b = e.create("empty", "t")
    assert b.dispatch(NOW) == 0 and e.store.table("job").first().status == S.COMPLETED
    with pytest.raises(KeyError):
        e.continue_("missing").add_rows("x", ["{}"]).dispatch(NOW)
    v = e.store.version()
    e.store.commit(v, {})
    with pytest.raises(Conflict):
        e.store.commit(v, {})


def test_fence_and_recovery(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w1"))
    e.create("n", "j").add_rows("k", ["{}", "{}"]).dispatch(NOW)
    claimed = e.poll(at(1))
    assert claimed.count() == 2
    other = Engine(spark, e.store.root, options=EngineOptions("w2"))
    assert other.poll(at(2)).count() == 0
    assert other.recover(at(60)) == 2  # w1 wasn't seen for long
    late = claimed.select(F.col("id").alias("task_id"), "attempt", F.lit(at(1)).alias("started_at"), F.lit(at(2)).alias("ended_at"), F.lit(None).cast(f"array<{S.ITEM}>").alias("report"), F.lit(False).alias("failed"))
    assert e.settle(late, at(61)) == (0, 0)  # the attempt was superseded
    assert other.poll(at(62)).first().attempt == 2
    assert e.store.table("attempt").where("outcome = 'Abandoned'").count() == 2


def test_pause_and_rebase(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w", reconcile_chunk=10, reconcile_pass=10))
    e.upsert_schedule(TypeSchedule("j|k", batch_size=5, gap_seconds=2.0))
    e.create("n", "j").add_rows("k", [json.dumps({"n": k}) for k in range(25)]).dispatch(NOW)
    e.pause_type("j|k")
    assert e.poll(at(1)).count() == 0
    assert e.reconcile(at(2)) == 10 and e.reconcile(at(3)) == 10 and e.reconcile(at(4)) == 5
    assert e.delete_schedule("j|k") == "PauseInProgress" and e.delete_schedule("none") == "NotFound"
    e.resume_type("j|k")
    later = at(5000)
    assert [e.reconcile(later) for _ in range(3)] == [10, 10, 5]
    orders = sorted(r[0] for r in e.store.table("task").select("schedule_order").collect())
    start = later.timestamp() if False else (later - datetime(1970, 1, 1)).total_seconds()
    assert orders == sorted([start + 2.0 * (k // 5) for k in range(25)])
    assert e.store.table("schedule").where("type_key = 'j|k'").first().pause_state == "active"
    assert e.delete_schedule("j|k") == "Deleted"


def test_two_specs_go_on_from_each_other(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(json.dumps({"n": k}), k) for k in range(3)], "payload string, n int")
    e.create("n", "j").add_tasks("k", df, "n").add_tasks("k", df, "n").dispatch(NOW)
    assert [r[0] for r in e.store.table("task").select("schedule_order").distinct().orderBy("schedule_order").collect()] == [1704067200.0, 1704067201.0]


def test_config_rules(spark):
    for bad in ({"batch_size": 0}, {"gap_seconds": 0.0}, {"gap_seconds": float("inf")}, {"max_attempts": 0}, {"pause_state": "x"}):
        with pytest.raises(ValueError):
            TypeSchedule("k", **bad)
    with pytest.raises(ValueError):
        TypeSchedule(S.DEFAULT_KEY, 1, None, 1)
    with pytest.raises(ValueError):
        EngineOptions(claim_batch=0)
    with pytest.raises(ValueError):
        Retention(timedelta(0))
    s = schedules(spark, TypeSchedule("k", batch_size=2))
    row = stamp.with_schedule(spark.createDataFrame([("k",), ("z",)], "type_key string"), s).orderBy("type_key").collect()
    assert [(r.batch_size, r.gap_seconds, r.max_attempts) for r in row] == [(2, 1.0, 5), (1000, 1.0, 5)]
    assert DEFAULT_SCHEDULE.batch_size == 1000


def test_weighted_ewma_numbers(spark):
    rows = [("t", 1, 2, 100.0, 50.0), ("t", 2, 1, 1000.0, 300.0)]
    df = spark.createDataFrame(rows, "type string, seq int, n int, m double, w double")
    r = compact.weighted_ewma(df, "type", F.col("seq"), "n", "m", "w").first()
    assert (round(r.avg_ms, 2), round(r.avg_wait_ms, 2), r.sample_count) == (446.15, 146.15, 3)
    rate = spark.createDataFrame([("t", 1, 0.25), ("t", 2, 0.75)], "type string, seq int, r double")
    assert round(compact.rate_ewma(rate, "type", F.col("seq"), "r").first().avg_retry_rate, 2) == 0.35


def test_chunks_of_five_targets(spark):
    rows = [("j", "Succeeded", None, f"t{k}") for k in range(5)] + [("j", "Failed", "x", None)]
    c = compact.chunks(spark.createDataFrame(rows, "job_id string, outcome string, output string, target_id string"), 2)
    got = {r.chunk_index: r.target_count for r in c.collect()}
    assert got == {0: 1, 1: 2, 2: 2}  # an item without targets takes a place and counts none


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = with_row_index(df, F.col("v"), parts=7).collect()
    assert all(r.v == r.k for r in rows) and len(rows) == 1000


def test_resume_ignores_active_types(spark):
    s = schedules(spark, TypeSchedule("k"))
    assert pause.resume(s, "k").where("type_key = 'k'").first().pause_state == "active"


def test_scalars():
    try:
        try:
            raise KeyError("a")
        except KeyError as e:
            raise ValueError("b") from e
    except ValueError as e:
        assert scalars.error_chain(e) == "ValueError: b -> KeyError: 'a'"
    assert scalars.calendar_range(2024, 12)[1] == datetime(2025, 1, 1)


def test_store_splits_ddl():
    from fanloom.store import _split

    assert len(_split(S.ATTEMPT)) == 10


def outcome(tasks, failed, ended, attempt=None):
    """Outcomes of claimed tasks."""
    return tasks.select(
        F.col("id").alias("task_id"), (F.col("attempt") if attempt is None else F.lit(attempt)).alias("attempt"), F.lit(at(1)).alias("started_at"), F.lit(ended).alias("ended_at"),
        F.lit(None).cast(f"array<{S.ITEM}>").alias("report"), F.lit(failed).alias("failed"),
    )


def test_repeated_payloads_are_tasks_of_their_own(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w"))
    df = spark.createDataFrame([("{}",), ("{}",), ('{"n":2}',)], "payload string")
    assert e.create("n", "j").add_tasks("k", df).add_rows("k", ["{}", "{}"]).dispatch(NOW) == 5
    assert e.store.table("task").select("id").distinct().count() == 5
    assert e.poll(at(10), 1).count() == 1 and e.store.table("task").count() == 5


def test_dispatch_has_no_window_over_one_partition(spark, tmp_path, monkeypatch):
    import fanloom.engine as module

    plans = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    e = Engine(spark, f"file://{tmp_path}/s")
    e.create("n", "j").add_tasks("k", spark.range(50).selectExpr("to_json(struct(id)) as payload")).dispatch(NOW)
    (plan,) = plans
    windows = [x for x in plan.split("\n") if "Window [" in x and "row_number" in x]
    assert windows and all("type_key" not in x.split("row_number")[1].split("ROWS")[0] for x in windows)


def test_an_attempt_settles_once_whatever_a_batch_holds(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w"))
    e.create("n", "j").add_rows("k", ['{"n":1}', '{"n":2}', '{"n":3}']).dispatch(NOW)
    claimed = e.poll(at(1)).orderBy("payload").select("id", "attempt", "payload")
    one, two, three = (claimed.where(F.col("payload") == f'{{"n":{k}}}') for k in (1, 2, 3))
    batch = outcome(one, True, at(2)).unionByName(outcome(one, False, at(2)))  # a tie: the success counts
    batch = batch.unionByName(outcome(two, False, at(3))).unionByName(outcome(two, True, at(2)))  # the failure ended first
    batch = batch.unionByName(outcome(three, False, at(2))).unionByName(outcome(three, False, at(2), 0))  # of a superseded attempt
    assert e.settle(batch.unionByName(batch), at(4)) == (2, 1)
    rows = {r.payload: r.state for r in e.store.table("task").collect()}
    assert rows == {'{"n":1}': S.SUCCEEDED, '{"n":2}': S.PENDING, '{"n":3}': S.SUCCEEDED} and e.store.table("task").count() == 3
    assert e.store.table("attempt").count() == 3


def test_a_conflict_is_retried_and_nothing_is_lost(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w"))
    e.create("n", "j").add_rows("k", ["{}", "{}"]).dispatch(NOW)
    claimed = e.poll(at(1))
    real, calls = e.store.commit, []

    def commit(base, *args, **named):
        if not calls:  # another writer is faster
            real(base, {})
        calls.append(base)
        return real(base, *args, **named)

    e.store.commit = commit
    assert e.settle(outcome(claimed, False, at(2)), at(3)) == (2, 0) and len(calls) == 2
    assert e.store.table("task").where(F.col("state") == S.SUCCEEDED).count() == 2 and e.store.table("attempt").count() == 2
    e.store.commit = lambda base, *args, **named: (_ for _ in ()).throw(Conflict("always"))
    with pytest.raises(Conflict):
        e.refresh(at(4))


def test_own_tasks_are_freed_after_a_restart_and_not_while_held(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w", self_grace=30.0))
    e.create("n", "j").add_rows("k", ["{}"]).dispatch(NOW)
    claimed = e.poll(at(1))
    assert e.recover(at(100)) == 0  # held
    again = Engine(spark, e.store.root, options=EngineOptions("w", self_grace=30.0))
    assert again.recover(at(20)) == 0 and again.recover(at(100)) == 1
    assert e.settle(outcome(claimed, False, at(2)), at(101)) == (0, 0)
    assert again.poll(at(102)).first().attempt == 2 and e.store.table("attempt").first().outcome == S.ABANDONED


def test_idle_loops_commit_nothing_and_settled_tasks_are_not_rewritten(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", options=EngineOptions("w"))
    e.create("n", "j").add_rows("k", ["{}", "{}", "{}"]).dispatch(NOW)
    v = e.store.version()
    assert e.recover(at(1)) == 0 and e.reconcile(at(1)) == 0 and e.compact(at(1)) == 0 and e.purge(at(1)) == 0 and e.store.version() == v
    cold = lambda: [p for p in e.store._read(e.store.version())["task"] if p.endswith("hot=false")]
    for k in range(3):
        kept = cold()
        e.settle(outcome(e.poll(at(2 + k), 1), False, at(3 + k)), at(4 + k))
        assert cold()[: len(kept)] == kept and len(cold()) == len(kept) + 1
    assert e.store.working().count() == 0 and e.store.table("task").count() == 3
    e.refresh(at(9))
    v = e.store.version()
    e.refresh(at(10))  # no active job
    assert e.store.version() == v and e.store.table("job").first().status == S.COMPLETED
    e.store.vacuum(1)
    assert e.store.table("task").count() == 3


def test_settled_tasks_are_gathered(spark, tmp_path, monkeypatch):
    import fanloom.store as module

    monkeypatch.setattr(module, "_MOST", 2)
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    row = lambda k, state: (f"{k}", "j", None, 0, "{}", "k", "j|k", state, 1, None, None, NOW, None, None, 0.0)
    for k in range(4):
        s.commit(k, None, None, hot=spark.createDataFrame([row(k, S.SUCCEEDED), row(9, S.PENDING)], S.TASK))
    assert len(s._read(4)["task"]) == 3 and s.table("task").count() == 5 and s.working().count() == 1
