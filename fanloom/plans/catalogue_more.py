"""Further named queries: sources, engine operations, loops and page arithmetic, each with its SQL.

They register in the same tables as those of ``catalogue``, which imports this module last.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.config import EngineOptions, TypeSchedule, violations
from fanloom.engine import Engine
from fanloom.functions import scalars
from fanloom.operators import compact, settle
from fanloom.plans import fixtures as X
from fanloom.plans import reads
from fanloom.plans.catalogue import _COUNTS, _EVENT_JOBS, _event_jobs, _ntz, _query, stamp_schedule
from fanloom.session import new_path
from fanloom.sources import adapters
from fanloom.streaming import loops

# -- sources ------------------------------------------------------------------------------------------------------


@_query("select n_name, n_regionkey from nation where n_regionkey = 1 and n_name < 'P'")
def source_bound_parameters(spark, sf):
    text = f"select n_name, n_regionkey from parquet.`{sf}/nation.parquet` where n_regionkey = :region and n_name < :below"
    return adapters.sql(spark, text, region=1, below="P")


@_query("select * from (values ('a', 1, 0), ('b', null, 1), ('a', 1, 2)) t(name, n, ord)")
def source_rows_in_memory(spark, sf):
    return adapters.rows(spark, [("a", 1), ("b", None), ("a", 1)], "name string, n int").withColumn("ord", F.col("ord").cast("int"))


@_query("select unnest(['x', 'y', null]) as id, unnest([1, 2, 3]) as attempt, unnest([true, false, true]) as failed")
def source_parallel_arrays(spark, sf):
    return adapters.unnested(spark, {"id": ["x", "y", None], "attempt": [1, 2, 3], "failed": [True, False, True]}, "id string, attempt int, failed boolean")


@_query("select instance_id, executing from fx_heartbeat where instance_id = 'u7' union all select instance_id, executing from fx_heartbeat where instance_id < 'u2'")
def source_table_rows(spark, sf):
    beats = X.heartbeat(spark, sf).select("instance_id", "executing")
    return adapters.table_rows(beats, "instance_id", "u7").unionByName(adapters.table_rows(beats.where("instance_id < 'u2'"), order="instance_id"))


@_query("select case when i < 1000 then 'TAX-1K' else 'TAX-10K' end as tax_code, count(*) as entities, count(*) * 6 as filings, true as sound from range(3000) r(i) group by 1")
def source_entities(spark, sf):
    e = adapters.entities(spark, 3000, 10)
    sound = (F.col("revenue") >= 0) & (F.col("headcount") < 500) & (F.length("id") == 32)
    return e.groupBy(F.col("taxCode").alias("tax_code")).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("filings")).alias("filings"), F.bool_and(sound).alias("sound"))


@_query("select 365 as days, 0 as first, 364 as last, true as sound")
def source_activity(spark, sf):
    sound = F.col("total").between(0, 14) & (F.col("failed") == (F.col("total") > 11).cast("int"))
    return adapters.activity(spark).agg(F.count(F.lit(1)).alias("days"), F.min("day_index").alias("first"), F.max("day_index").alias("last"), F.bool_and(sound).alias("sound"))


# -- engine operations --------------------------------------------------------------------------------------------


@_query("select * from (values ('first', 5, 'Active', 5), ('fired', 1, 'Active', 1), ('none', 0, 'Completed', 0)) t(name, task_count, status, tasks)")
def engine_continue_and_fire(spark, sf):
    """A job of three tasks that two more are added to, a job of one task, and one without any."""
    e = Engine(spark, new_path(spark, "engine"))
    first = e.create("first", "t").add_rows("k", ["{}", "{}", "{}"])
    first.dispatch(X.NOW)
    e.continue_(first.job_id, "t").add_rows("k", ["{}"]).add_rows("k", ["{}"]).dispatch(X.NOW)
    e.fire("fired", "{}", "k", "{}", X.NOW)
    e.create("none", "t").dispatch(X.NOW)
    tasks = e.store.table("task").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("tasks"))
    return e.store.table("job").join(tasks, "id", "left").select("name", "task_count", "status", F.coalesce("tasks", F.lit(0)).alias("tasks"))


@_query("select * from (values ('__default__', 1000, 1.0::double, 5, 'active', 'Deleted'), ('a|k', 7, null, null, 'active', 'Deleted'), ('c|k', null, null, null, 'paused', 'Deleted')) t(type_key, batch_size, gap_seconds, max_attempts, pause_state, said)")
def engine_schedule_changes(spark, sf):
    """Overwriting, inserting where absent, deleting, and pausing a type that has no row."""
    e = Engine(spark, new_path(spark, "engine"))
    e.upsert_schedule(TypeSchedule("a|k", batch_size=3))
    e.upsert_schedule(TypeSchedule("a|k", batch_size=7))
    e.seed_schedules(TypeSchedule("a|k", batch_size=9), TypeSchedule("b|k", gap_seconds=2.0))
    e.pause_type("c|k")
    said = e.delete_schedule("b|k")
    return e.store.table("schedule").withColumn("said", F.lit(said))


@_query("select * from (values ('job', 1), ('job_faulted', 0), ('succeeded', 3), ('abandoned', 1), ('waiting', 0)) t(what, n)")
def engine_recovered_and_settled(spark, sf):
    """A worker that is lost after a claim of one of three tasks; another one frees it and works all of them off."""
    at = lambda s: datetime.fromtimestamp(X.NOW.timestamp() + s)
    done = F.array(F.struct(F.lit(S.SUCCEEDED).alias("outcome"), F.lit(None).cast("string").alias("output"), F.array().cast("array<string>").alias("targetIds")))
    lost = Engine(spark, new_path(spark, "engine"), options=EngineOptions("lost"))
    lost.registry.add_handler("t", "k", column=lambda df: done)
    lost.create("n", "t").add_rows("k", ["{}", "{}", "{}"]).dispatch(at(0))
    lost.poll(at(1), 1)
    other = Engine(spark, lost.store.root, lost.registry, EngineOptions("other"))
    other.recover(at(100))
    other.work(at(101))
    other.refresh(at(102))
    jobs, tasks, attempts = (other.store.table(t) for t in ("job", "task", "attempt"))
    count = lambda what, df: df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(what).alias("what"), "n")
    out = count("job", jobs.where("status = 'Completed'"))
    for what, df in (("job_faulted", jobs.where("status = 'Faulted'")), ("succeeded", attempts.where("outcome = 'Succeeded'")), ("abandoned", attempts.where("outcome = 'Abandoned'")), ("waiting", tasks.where("state = 'Pending'"))):
        out = out.unionByName(count(what, df))
    return out


@_query("""select * from (values (1, 'batch_size'), (2, 'gap_seconds'), (3, 'gap_seconds'), (4, 'max_attempts'), (5, 'pause_state'), (6, 'type_key'), (7, 'batch_size'), (7, 'gap_seconds'), (8, 'default')) t(n, rule)""")
def schedule_violations(spark, sf):
    """Rows of a schedule table that break a rule, a row for each rule that is broken."""
    rows = [
        (0, "good", 1, 0.5, 1, "active"), (1, "k", 0, 1.0, 1, "active"), (2, "k", 1, 0.0, 1, "active"), (3, "k", 1, float("inf"), 1, "active"), (4, "k", 1, 1.0, 0, "paused"), (5, "k", None, None, None, "x"),
        (6, " ", None, None, None, "active"), (7, "k", -1, float("nan"), None, "active"), (8, S.DEFAULT_KEY, 1, None, 1, "active"), (9, S.DEFAULT_KEY, 1, 1.0, 1, "active"),
    ]
    df = spark.createDataFrame(rows, "n int, " + S.SCHEDULE)
    return df.select("n", F.explode(violations()).alias("rule"))


@_query("select * from (values ('claim_batch', '128'), ('compact_every', '5.0'), ('instance_id', 'local'), ('stale_after', '15.0')) t(name, value)")
def engine_info(spark, sf):
    return reads.engine_info(spark, EngineOptions()).where(F.col("name").isin("claim_batch", "compact_every", "instance_id", "stale_after"))


# -- settlement, metrics ------------------------------------------------------------------------------------------


@_query("""select id || '#' || attempt as id, id as task_id, job_id, attempt, 'Succeeded' as outcome, cast(greatest(0, floor((epoch_us(timestamp '2000-01-01 00:00:00') - epoch_us(claimed_at)) / 1000)) as bigint) as duration_ms
from fx_task where state = 'Running' and job_id % 2 = 0""")
def settle_audit_rows(spark, sf):
    ran = X.task(spark, sf).where("state = 'Running' and job_id % 2 = 0")
    o = ran.select(F.col("id").alias("task_id"), "attempt", F.col("claimed_at").alias("started_at"), F.lit(X.NOW).cast("timestamp_ntz").alias("ended_at"), F.lit(None).cast(f"array<{S.ITEM}>").alias("report"))
    rows = settle.attempts(settle.complete(X.task(spark, sf), o, X.NOW), S.SUCCEEDED)
    return rows.select("id", "task_id", "job_id", "attempt", "outcome", "duration_ms")


@_query("select type_key, count(*) as claimed, count(*) filter (where outcome <> 'Failed') as succeeded, count(*) filter (where outcome = 'Failed') as failed, round(avg(duration_ms), 6) as mean_ms from fx_attempt group by 1")
def metrics_by_type(spark, sf):
    a = X.attempt(spark, sf).withColumn("failed", F.col("outcome") == S.FAILED)
    return loops.event_metrics(a, a).withColumn("mean_ms", F.round("mean_ms", 6))


@_query("select type_key, cast(least(floor(duration_ms / 1000), 5) as int) as bucket, count(*) as attempts from fx_attempt group by all")
def metrics_duration_histogram(spark, sf):
    return loops.duration_histogram(X.attempt(spark, sf), [1000, 2000, 3000, 4000, 5000])


@_query("select type_key, round(avg((epoch_us(claimed_at) - epoch_us(created_at)) / 1000.0), 3) as wait_ms, count(*) as n from fx_task group by 1")
def mean_wait(spark, sf):
    """A null time is skipped, as for means of attempts that never began."""
    t = X.task(spark, sf)
    return t.groupBy("type_key").agg(F.round(F.avg(scalars.wait_ms(F.col("created_at"), F.col("claimed_at"))), 3).alias("wait_ms"), F.count(F.lit(1)).alias("n"))


@_query("select outcome, case when duration_ms % 2 = 0 then 'even' end as output, count(*) as targets from fx_attempt group by all")
def report_groups(spark, sf):
    """Targets by outcome and output; a null output is a key of its own."""
    a = X.attempt(spark, sf).select("outcome", F.when(F.col("duration_ms") % 2 == 0, "even").alias("output"))
    return a.groupBy("outcome", "output").agg(F.count(F.lit(1)).alias("targets"))


@_query("select job_id, state, count(*) as tasks from fx_task group by all")
def running_counts(spark, sf):
    return loops.running_counts(X.task(spark, sf))


@_query("select date_trunc('hour', started_at)::timestamp as start, outcome, count(*) as attempts from fx_attempt group by all")
def windowed_outcomes(spark, sf):
    return loops.windowed_outcomes(X.attempt(spark, sf)).withColumns(_ntz("start"))


@_query("""select * from (with recursive m as (select type_key, job_id, count(*) as n, avg(duration_ms) as v from fx_attempt where outcome <> 'Abandoned' group by all),
o as (select *, row_number() over (partition by type_key order by job_id) as k from m),
f as (select type_key, k, v::double as avg_ms, n::double as weight from o where k = 1
    union all select o.type_key, o.k, (f.weight * 0.8 * f.avg_ms + o.n * o.v) / (f.weight * 0.8 + o.n), f.weight * 0.8 + o.n from f join o on o.type_key = f.type_key and o.k = f.k + 1)
select type_key, round(avg_ms, 4) as avg_ms, round(weight, 4) as weight from f where (type_key, k) in (select type_key, max(k) from o group by 1))""")
def type_ewma_folded(spark, sf):
    """The closed form against a fold, job after job."""
    means = X.attempt(spark, sf).where("outcome <> 'Abandoned'").groupBy("type_key", "job_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"))
    m = compact.weighted_ewma(means, "type_key", F.col("job_id"), "n", "m")
    return m.select("type_key", F.round("avg_ms", 4).alias("avg_ms"), F.round("weight", 4).alias("weight"))


# -- order and page arithmetic ------------------------------------------------------------------------------------


@_query("""with k as (select tax_code as type_key, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company),
c as (select type_key, coalesce(s.batch_size, 1000) as b, coalesce(s.gap_seconds, 1.0) as g, k from k left join fx_schedule s using (type_key)),
n as (select type_key, any_value(g) as gap, max(k // b) as slots from c group by 1)
select type_key, cast(gap as double) as spacing, slots from n where slots > 0""")
def slot_spacing(spark, sf):
    """Distances between one slot of a type and the next."""
    slots = stamp_schedule(spark, sf).select("type_key", "schedule_order").distinct()
    gap = F.col("schedule_order") - F.lag("schedule_order").over(Window.partitionBy("type_key").orderBy("schedule_order"))
    return slots.withColumn("spacing", F.round(gap, 6)).where("spacing is not null").groupBy("type_key", "spacing").agg(F.count(F.lit(1)).alias("slots"))


@_query("select event_type as type_key, count(*) as n, cast(row_number() over (order by count(*) desc, event_type) as int) as place from events group by 1 order by n desc, type_key limit 2")
def top_two(spark, sf):
    counts = X.table(spark, sf, "events").groupBy(F.col("event_type").alias("type_key")).agg(F.count(F.lit(1)).alias("n"))
    return reads.top(counts, 2, F.desc("n"), F.col("type_key"))


@_query("select max_by(event_type, (n, event_type)) as type_key, max(n) as n from (select event_type, count(*) as n from events group by 1)")
def top_one(spark, sf):
    counts = X.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("event_type", F.struct("n", "event_type")).alias("type_key"), F.max("n").alias("n"))


@_query(f"with {_EVENT_JOBS}, h as (select month(created_at) as m, {_COUNTS} from ej where year(created_at) = 2024 group by 1) select cast(i as int) as month, coalesce(total, 0) as total, coalesce(active, 0) as active, coalesce(completed, 0) as completed, coalesce(faulted, 0) as faulted from range(1, 13) r(i) left join h on h.m = i")
def grid_year(spark, sf):
    return reads.grid_year(reads.histogram(_event_jobs(spark, sf), "month", "UTC", datetime(2024, 1, 1), datetime(2025, 1, 1)), 2024)


@_query(f"with {_EVENT_JOBS} select id, round(least(1.0, greatest(0.0, (epoch_us(created_at) - epoch_us(timestamp '2024-01-05')) / 864000000000.0)), 9) as x from ej")
def axis_positions(spark, sf):
    x = scalars.axis_position(F.col("created_at"), datetime(2024, 1, 5), datetime(2024, 1, 15))
    return _event_jobs(spark, sf).select("id", F.round(x, 9).alias("x"))


@_query("""select * from (values (1, timestamp '2024-01-01', timestamp '2025-01-01', 'day'), (2, timestamp '2024-12-01', timestamp '2025-01-01', 'day'), (3, timestamp '2024-02-28', timestamp '2024-02-29', 'hour'),
(4, timestamp '2024-02-29 23:00:00', timestamp '2024-03-01 00:00:00', 'minute'), (5, timestamp '2024-02-29 23:59:00', timestamp '2024-03-01 00:00:00', 'second'), (6, timestamp '2024-12-31 23:59:59', timestamp '2025-01-01 00:00:00', 'second')) t(parts, start, finish, bucket)""")
def calendar_ranges(spark, sf):
    asked = [(2024,), (2024, 12), (2024, 2, 28), (2024, 2, 29, 23), (2024, 2, 29, 23, 59), (2024, 12, 31, 23, 59, 59)]
    return spark.createDataFrame([(len(a), *scalars.calendar_range(*a)) for a in asked], "parts int, start timestamp_ntz, finish timestamp_ntz, bucket string")


@_query("select p, size, case when size > 0 then cast(floor(p * 100.0 / size + 0.5) as int) else 0 end as progress from (select p_partkey % 50 as p, p_size as size from part union all select 0, 0)")
def progress_percent(spark, sf):
    p = X.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("p"), F.col("p_size").alias("size")).unionByName(spark.createDataFrame([(0, 0)], "p bigint, size int"))
    return p.select("p", "size", scalars.progress(F.col("p"), F.col("size")).alias("progress"))


@_query("select id, cast(greatest(0, floor((epoch_us(next_attempt_at) - epoch_us(claimed_at)) / 1000)) as bigint) as ms from fx_task where next_attempt_at is not null")
def durations(spark, sf):
    """Whole milliseconds, 0 where the end is before the start."""
    return X.task(spark, sf).where("next_attempt_at is not null").select("id", scalars.duration_ms(F.col("claimed_at"), F.col("next_attempt_at")).alias("ms"))
