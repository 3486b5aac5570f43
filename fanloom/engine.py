"""The engine: jobs, tasks and attempts in a snapshot store, and one tick of every loop."""

from __future__ import annotations

import functools
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom import schema as S
from fanloom.config import DEFAULT_SCHEDULE, EngineOptions, Retention, TypeSchedule
from fanloom.functions import scalars
from fanloom.handlers import Registry
from fanloom.operators import claim, compact, pause, recover, settle, stamp, stats
from fanloom.operators.rowindex import with_row_index
from fanloom.session import materialise
from fanloom.store import Conflict, SnapshotStore

TRIES = 5


def _retried(f):
    """Reads again and redoes an operation when another writer committed first, ``TRIES`` times at most."""

    @functools.wraps(f)
    def run(self, *args, **named):
        for left in range(TRIES - 1, -1, -1):
            try:
                return f(self, *args, **named)
            except Conflict:
                if not left:
                    raise

    return run


class JobBuilder:
    """Collects specifications of tasks and dispatches them as one job, in one commit."""

    def __init__(self, engine: "Engine", job_id: str, name: str, job_type: str, payload: str | None, existing: bool, parent: str | None = None):
        self.engine, self.job_id, self.name, self.type, self.payload = engine, job_id, name, job_type, payload
        self.existing, self.parent = existing, parent
        self.specs: list[tuple[str, DataFrame, bool]] = []

    def add_tasks(self, task_type: str, payloads: DataFrame, *order: str) -> "JobBuilder":
        """``payloads`` has ``payload`` and the columns of ``order``, their total order."""
        ranked = payloads.select("payload", F.struct(*(order or ["payload"])).alias("ord"))
        self.specs.append((task_type, ranked, False))
        return self

    def add_rows(self, task_type: str, items: list[str]) -> "JobBuilder":
        """Payloads in memory; specifications of one type count on from one another."""
        df = self.engine.spark.createDataFrame(list(enumerate(items)), "n bigint, payload string")
        self.specs.append((task_type, df.select("payload", F.struct("n").alias("ord")), True))
        return self

    @_retried
    def dispatch(self, now: datetime) -> int:
        """Stamps the specifications one after the other and commits job and tasks; returns the number of tasks.

        Every payload becomes a task of its own, equal ones too: a task's id comes from its place in the total order,
        which is counted over range partitions, not in one task."""
        e = self.engine
        base = e.store.version()
        jobs, old, schedule = e.store.table("job", base), e.store.working(base), e.store.table("schedule", base)
        if self.existing and not jobs.where(F.col("id") == self.job_id).limit(1).count():
            raise KeyError(f"job {self.job_id} isn't there")
        specs: list[tuple[str, list[DataFrame]]] = []
        for kind, df, memory in self.specs:
            if memory and specs and specs[-1][0] == kind and specs[-1][2]:
                specs[-1][1].append(df)
            else:
                specs.append((kind, [df], memory))
        seen = old.select("job_id", "type_key", "schedule_order", "state")
        out = None
        for k, (kind, frames, memory) in enumerate(specs):
            rows = None
            for j, f in enumerate(frames):
                f = f.withColumn("part", F.lit(j)).withColumn("ord", F.to_json("ord")) if len(frames) > 1 else f.withColumn("part", F.lit(0))
                rows = f if rows is None else rows.unionByName(f)
            key = S.type_key(F.lit(self.type), F.lit(kind))
            new = rows.select(F.lit(self.job_id).alias("job_id"), key.alias("type_key"), "payload", "part", "ord", F.lit(kind).alias("payload_type"))
            new = with_row_index(new, F.col("part"), F.col("ord"), F.col("payload"), name="place")
            stamped = stamp.stamp(new, seen, schedule, now, index="place")
            stamped = stamped.withColumns(
                {
                    "id": F.md5(F.concat_ws("|", F.lit(self.job_id), F.lit(f"{base}-{k}"), F.col("place").cast("string"))),
                    "parent_task_id": F.lit(self.parent).cast("string"), "task_index": F.lit(0).cast("bigint"), "attempt": F.lit(0), "claimed_by": F.lit(None).cast("string"),
                    "next_attempt_at": F.lit(None).cast("timestamp"), "created_at": F.lit(now), "claimed_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp"),
                }
            )
            stamped = materialise(stamped.drop("part", "ord", "place"), "stamped")
            seen = seen.unionByName(stamped.select("job_id", "type_key", "schedule_order", "state"))
            out = stamped if out is None else out.unionByName(stamped)
        n = out.count() if out is not None else 0
        if self.existing:
            mine = F.col("id") == self.job_id
            grown = jobs.withColumn("task_count", F.when(mine, F.col("task_count") + n).otherwise(F.col("task_count")))
            e.store.commit(base, {"job": grown}, {"task": out} if n else None)
        else:
            done = n == 0
            row = (self.job_id, self.name, self.type, self.payload, self.type, S.COMPLETED if done else S.ACTIVE, n, n, 0, 0, 0, 0, now if done else None, now, now if done else None, None, None, None, None)
            e.store.commit(base, None, {"job": e.spark.createDataFrame([row], S.JOB)} | ({"task": out} if n else {}))
        return n


class Engine:
    """All operations on a store; each reads one snapshot and commits the next."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, options: EngineOptions | None = None, retention: Retention | None = None):
        self.spark, self.registry = spark, registry or Registry()
        self.options, self.retention = options or EngineOptions(), retention or Retention()
        self.store = SnapshotStore(spark, root)
        self.held: list[DataFrame] = []  # what this engine has claimed and not settled
        if not self.store.version():
            self.store.commit(0, {"schedule": spark.createDataFrame([DEFAULT_SCHEDULE.row()], S.SCHEDULE)})
        self.seed_schedules(*self.registry.schedules.values())

    # jobs

    def create(self, name: str, job_type: str = "default", payload: str | None = None, job_id: str | None = None) -> JobBuilder:
        return JobBuilder(self, job_id or str(uuid.uuid4()), name, job_type, payload, False)

    def continue_(self, job_id: str, job_type: str = "default", parent: str | None = None) -> JobBuilder:
        """More tasks for a job; with ``parent``, a task that must be running, as its children."""
        if parent is not None:
            mine = self.store.working().where((F.col("id") == parent) & (F.col("state") == S.RUNNING))
            if not mine.limit(1).count():
                raise ValueError(f"task {parent} isn't running")
        return JobBuilder(self, job_id, "", job_type, None, True, parent)

    def fire(self, name: str, payload: str, task_type: str, task_payload: str, now: datetime, job_type: str = "default") -> str:
        b = self.create(name, job_type, payload)
        b.add_rows(task_type, [task_payload]).dispatch(now)
        return b.job_id

    # schedules

    @_retried
    def _schedule(self, change) -> None:
        v = self.store.version()
        self.store.commit(v, {"schedule": change(self.store.table("schedule", v))})

    def upsert_schedule(self, row: TypeSchedule) -> None:
        new = self.spark.createDataFrame([row.row()], S.SCHEDULE)
        self._schedule(lambda s: s.join(new.select("type_key"), "type_key", "left_anti").unionByName(new))

    def seed_schedules(self, *rows: TypeSchedule) -> None:
        """Adds rows of types that have none."""
        if rows:
            new = self.spark.createDataFrame([r.row() for r in rows], S.SCHEDULE)
            self._schedule(lambda s: s.unionByName(new.join(s.select("type_key"), "type_key", "left_anti")))

    def delete_schedule(self, key: str) -> str:
        """Deleted, NotFound, or PauseInProgress for a type that isn't active; the default row stays."""
        if key == S.DEFAULT_KEY:
            raise ValueError("the default row can't be deleted")
        row = self.store.table("schedule").where(F.col("type_key") == key).select("pause_state").first()
        if row is None:
            return "NotFound"
        if row[0] != "active":
            return "PauseInProgress"
        self._schedule(lambda s: s.where(F.col("type_key") != key))
        return "Deleted"

    def pause_type(self, key: str) -> None:
        self._schedule(lambda s: pause.pause(s, key))

    def resume_type(self, key: str, rebase: bool = True) -> None:
        self._schedule(lambda s: pause.resume(s, key, rebase))

    # loops

    @_retried
    def poll(self, now: datetime, limit: int | None = None) -> DataFrame:
        """Beats and claims; the claimed tasks with their context, committed as running."""
        v, o = self.store.version(), self.options
        tasks = self.store.working(v)
        found, beats = claim.poll(tasks, self.store.table("job", v), self.store.table("schedule", v), self.store.table("heartbeat", v), now, o.claim_batch if limit is None else limit, o.instance_id)
        claimed = materialise(found, "claimed")
        some = claimed.limit(1).count() > 0
        self.store.commit(v, {"heartbeat": beats}, hot=settle.merged(tasks, claimed) if some else None)
        if some:
            self.held.append(claimed.select("id"))
        return claimed

    @_retried
    def settle(self, outcomes: DataFrame, now: datetime) -> tuple[int, int]:
        """Takes outcomes of attempts in; returns how many tasks succeeded and failed (or go again). Of several outcomes
        of one attempt, of whatever kind, one counts."""
        v, o = self.store.version(), self.options
        tasks, schedule = self.store.working(v), self.store.table("schedule", v)
        done, bad = settle.settled(tasks, outcomes, schedule, now, o.instance_id, int(o.backoff_base * 1000), int(o.backoff_max * 1000))
        done, bad = materialise(done, "done"), materialise(bad, "bad")
        counts = done.count(), bad.count()
        if not any(counts):
            return counts
        columns = tasks.columns
        moved = done.select(*columns).unionByName(bad.select(*columns))
        audit = settle.attempts(done, S.SUCCEEDED).unionByName(settle.attempts(bad, S.FAILED))
        self.store.commit(v, None, {"attempt": audit}, hot=settle.merged(tasks, moved))
        return counts

    def work(self, now: datetime, limit: int | None = None) -> tuple[int, int]:
        """Claim, execute and settle once. What was claimed is held no longer afterwards, whatever happened."""
        before = len(self.held)
        claimed = self.poll(now, limit)
        try:
            outcomes = materialise(self.registry.execute(claimed, now), "outcomes")
            return self.settle(outcomes, now)
        finally:
            del self.held[before:]

    def _holding(self, tasks: DataFrame) -> DataFrame:
        """Ids that this engine holds; claims of which nothing runs any more are forgotten."""
        running = tasks.where(F.col("state") == S.RUNNING).select("id")
        self.held = [h for h in self.held if running.join(h, "id", "left_semi").limit(1).count()]
        keep = running.limit(0)
        for h in self.held:
            keep = keep.unionByName(h)
        return keep

    @_retried
    def recover(self, now: datetime) -> int:
        """Frees the tasks of instances that are gone, and those that run in this one's name for long without its
        holding them (as after a restart); their attempts count as abandoned."""
        v, o = self.store.version(), self.options
        tasks, beats, schedule = self.store.working(v), self.store.table("heartbeat", v), self.store.table("schedule", v)
        freed, left = recover.stale(tasks, beats, schedule, now, timedelta(seconds=o.stale_after), o.instance_id)
        own = recover.self_stranded(tasks, schedule, now, timedelta(seconds=o.self_grace), o.instance_id, self._holding(tasks))
        freed = materialise(freed.select(*tasks.columns).unionByName(own.select(*tasks.columns)), "freed")
        n, gone = freed.count(), recover.dead(beats, now, timedelta(seconds=o.stale_after), o.instance_id).limit(1).count()
        if n or gone:
            self.store.commit(v, {"heartbeat": left}, {"attempt": recover.abandoned(freed, now)} if n else None, hot=settle.merged(tasks, freed) if n else None)
        return n

    @_retried
    def reconcile(self, now: datetime) -> int:
        v, o = self.store.version(), self.options
        tasks, schedule = self.store.working(v), self.store.table("schedule", v)
        if not schedule.where(F.col("pause_state") != "active").limit(1).count():
            return 0
        moved = materialise(pause.reconcile(tasks, schedule, now, o.reconcile_chunk, o.reconcile_pass).select(*tasks.columns), "moved")
        n = moved.count()
        after = settle.merged(tasks, moved)
        active = pause.activated(schedule, after)
        if n or active.where("pause_state = 'active'").count() != schedule.where("pause_state = 'active'").count():
            self.store.commit(v, {"schedule": active}, hot=after if n else None)
        return n

    @_retried
    def refresh(self, now: datetime) -> None:
        v = self.store.version()
        jobs = self.store.table("job", v)
        if jobs.where(F.col("status") == S.ACTIVE).limit(1).count():
            self.store.commit(v, {"job": stats.refresh(jobs, self.store.table("task", v), now, self.store.table("attempt", v))})

    @_retried
    def compact(self, now: datetime) -> int:
        """Compacts finished jobs, all in one pass: chunks, means, metrics, expiry; their tasks and attempts go."""
        v, o = self.store.version(), self.options
        jobs, tasks, attempts = (self.store.table(t, v) for t in ("job", "task", "attempt"))
        ready = materialise(compact.ready(jobs, o.compact_jobs).select(F.col("id").alias("job_id"), "completed_at"), "ready")
        if not ready.limit(1).count():
            return 0
        mine = attempts.join(F.broadcast(ready.select("job_id")), "job_id", "left_semi")
        chunk = compact.chunks(compact.exploded(mine), o.chunk_targets).withColumn("created_at", F.lit(now))
        means = compact.job_means(mine).withColumnRenamed("job_id", "id")
        retries = mine.where("attempt > 1").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n_retry"))
        updated = jobs.drop("avg_duration_ms", "attempt_sample_count").join(means.withColumnRenamed("sample_count", "attempt_sample_count"), "id", "left").join(retries, "id", "left").join(ready.select(F.col("job_id").alias("id"), F.lit(True).alias("now_ready")), "id", "left")
        old = jobs.select("id", F.col("avg_duration_ms").alias("old_ms"), F.col("attempt_sample_count").alias("old_n"))
        updated = compact.expiry(updated.join(old, "id"), self.retention).withColumns(
            {
                "compacted_at": F.when(F.col("now_ready"), F.lit(now)).otherwise(F.col("compacted_at")),
                "avg_duration_ms": F.coalesce("avg_duration_ms", "old_ms"),
                "attempt_sample_count": F.coalesce("attempt_sample_count", "old_n"),
                "retry_count": F.when(F.col("now_ready"), F.coalesce("n_retry", F.lit(0))).otherwise(F.col("retry_count")),
            }
        )
        typed = mine.where("outcome = 'Succeeded'").join(tasks.select(F.col("id").alias("task_id"), "type_key"), "task_id")
        wait = scalars.wait_ms(F.col("claimed_at"), F.col("started_at"))
        means_by_job = typed.groupBy("type_key", "job_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"), F.avg(wait).alias("w")).join(F.broadcast(ready), "job_id")
        order = F.struct("completed_at", "job_id")
        fresh = compact.weighted_ewma(means_by_job, "type_key", order, "n", "m", "w")
        rates = compact.retry_rates(tasks.join(F.broadcast(ready.select("job_id")), "job_id", "left_semi"), mine).join(F.broadcast(ready), "job_id")
        fresh = fresh.join(compact.rate_ewma(rates, "type_key", order, "rate"), "type_key", "full_outer")
        counts = means_by_job.groupBy("type_key").agg(F.count(F.lit(1)).alias("k")).join(rates.groupBy("type_key").agg(F.count(F.lit(1)).alias("kr")), "type_key", "full_outer")
        metric = self._blend(self.store.table("metric", v), fresh.join(counts, "type_key"))
        gone = ready.select("job_id")
        self.store.commit(
            v,
            {"job": updated, "metric": metric, "task": tasks.join(F.broadcast(gone), "job_id", "left_anti"), "attempt": attempts.join(F.broadcast(gone), "job_id", "left_anti")},
            {"chunk": chunk},
        )
        return ready.count()

    @staticmethod
    def _blend(old: DataFrame, new: DataFrame) -> DataFrame:
        """Metric rows after k more jobs at once: the old weight decays k times."""
        renamed = new.select("type_key", *[F.col(c).alias(f"n_{c}") for c in ("avg_ms", "weight", "sample_count", "avg_wait_ms", "avg_retry_rate", "k", "kr")])
        j = old.join(renamed, "type_key", "full_outer")
        w0 = F.coalesce("weight", F.lit(0.0)) * F.pow(F.lit(compact.DECAY), F.coalesce("n_k", F.lit(0)))
        w1 = F.coalesce("n_weight", F.lit(0.0))

        def mix(a, b, wa, wb):
            return F.when(F.col(b).isNull(), F.col(a)).when(F.col(a).isNull(), F.col(b)).otherwise((wa * F.col(a) + wb * F.col(b)) / F.nullif(wa + wb, F.lit(0.0)))

        kept = F.pow(F.lit(1 - compact.ALPHA), F.coalesce("n_kr", F.lit(0)))
        return j.select(
            "type_key", (F.coalesce("sample_count", F.lit(0)) + F.coalesce("n_sample_count", F.lit(0))).alias("sample_count"), (w0 + w1).alias("weight"),
            mix("avg_ms", "n_avg_ms", w0, w1).alias("avg_ms"), mix("avg_wait_ms", "n_avg_wait_ms", w0, w1).alias("avg_wait_ms"), mix("avg_retry_rate", "n_avg_retry_rate", kept, 1 - kept).alias("avg_retry_rate"),
        )

    @_retried
    def purge(self, now: datetime) -> int:
        v = self.store.version()
        jobs, chunk = self.store.table("job", v), self.store.table("chunk", v)
        n = compact.purgeable(jobs, now, self.options.purge_limit).count()
        if n:
            left, rest = compact.purge(jobs, chunk, now, self.options.purge_limit)
            self.store.commit(v, {"job": left, "chunk": rest})
        return n

    def report(self, job_id: str) -> DataFrame:
        return compact.read_report(self.store.table("chunk").where(F.col("job_id") == job_id)).orderBy("chunk_index", "pos")

    def tick(self, now: datetime) -> None:
        """One round of all loops."""
        self.recover(now)
        self.work(now)
        self.reconcile(now)
        self.refresh(now)
        self.compact(now)
        self.purge(now)
