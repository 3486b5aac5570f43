"""The named queries of the engine over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.config import Retention
from fanloom.engine import Engine
from fanloom.functions import reports, scalars
from fanloom.operators import claim, compact, fanout, pause, recover, settle, stamp, stats
from fanloom.plans import fixtures as X
from fanloom.plans import reads
from fanloom.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS = {"fx_schedule": X.SCHEDULE_SQL, "fx_company": X.COMPANY_SQL, "fx_job": X.JOB_SQL, "fx_task": X.TASK_SQL, "fx_attempt": X.ATTEMPT_SQL, "fx_heartbeat": X.HEARTBEAT_SQL}
_NOW = f"timestamp '{X.NOW}'"


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            used = [v for k, v in _VIEWS.items() if k in sql]
            own = sql.strip()
            if own.lower().startswith("with "):
                own = ", " + own[5:] if used else own
            ORACLES[key] = ("with " + ", ".join(used) + "\n" + own) if used else own
        return f

    return add


def _ntz(*names: str):
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


# -- fan-out ------------------------------------------------------------------------------------------------------


@_query("select to_json({'companyId': company_id, 'name': name, 'taxCode': tax_code})::varchar as payload from fx_company where tax_code = 'BUILDING'")
def fanout_one_to_one(spark, sf):
    c = X.company(spark, sf)
    return fanout.one_to_one(c, F.col("tax_code") == "BUILDING", F.col("company_id").alias("companyId"), "name", F.col("tax_code").alias("taxCode"))


@_query("select to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey})::varchar as payload from supplier where s_nationkey < 10")
def fanout_relational_source(spark, sf):
    s = X.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return fanout.one_to_one(s, "s_nationkey < 10")


@_query("""with b as (select company_id, (row_number() over (order by company_id) - 1) // 50 as batch from fx_company where tax_code <> 'BUILDING')
select cast(batch as bigint) as batch, '{"CompanyIds":[' || string_agg(company_id::varchar, ',' order by company_id) || ']}' as payload from b group by batch""")
def fanout_batched(spark, sf):
    return fanout.batched(X.company(spark, sf), F.col("tax_code") != "BUILDING", F.col("company_id"), "CompanyIds", 50, "company_id")


@_query("select to_json({'country': country, 'companies': count(*)})::varchar as payload from fx_company group by country")
def fanout_raw_sql(spark, sf):
    sql = "select to_json(named_struct('country', country, 'companies', count(*))) from {companies} group by country ; "
    return fanout.raw_sql(spark, sql, companies=X.company(spark, sf))


def _new_tasks(spark, sf):
    c = X.company(spark, sf)
    return c.select(F.lit(1).cast("bigint").alias("job_id"), F.col("tax_code").alias("type_key"), F.col("company_id").alias("task_index"))


def _existing(spark, sf):
    """Waiting tasks of the same kinds: one in three companies of two types."""
    rows = _new_tasks(spark, sf).where("task_index % 3 = 0 and type_key in ('BUILDING', 'HOUSEHOLD')")
    key = F.lit(X.EPOCH) + F.col("task_index") * 0.5
    return rows.select(F.when(F.col("type_key") == "BUILDING", 1).otherwise(2).cast("bigint").alias("job_id"), "type_key", key.alias("schedule_order"), F.lit(S.PENDING).alias("state"))


_EXISTING = "ex as (select case when tax_code = 'BUILDING' then 1 else 2 end as job_id, tax_code as type_key, 946684800.0 + company_id * 0.5 as schedule_order from fx_company where company_id % 3 = 0 and tax_code in ('BUILDING', 'HOUSEHOLD'))"
_BASES = f"""{_EXISTING}, fr as (select greatest(946684800.0, min(schedule_order)) as frontier from ex),
cfg as (select distinct c.tax_code as type_key, coalesce(s.batch_size, d.batch_size) as batch_size, coalesce(s.gap_seconds, d.gap_seconds) as gap_seconds, coalesce(s.max_attempts, d.max_attempts) as max_attempts, coalesce(s.pause_state, 'active') as pause_state
    from fx_company c left join fx_schedule s on s.type_key = c.tax_code cross join (select * from fx_schedule where type_key = '__default__') d),
ba as (select cfg.*, coalesce((select max(schedule_order) from ex where ex.type_key = cfg.type_key and ex.job_id = 1) + gap_seconds, frontier) as base from cfg cross join fr)"""


@_query(f"with {_BASES} select type_key, cast(base as double) as base, batch_size, gap_seconds, pause_state from ba")
def base_frontier_tail(spark, sf):
    b = stamp.bases(_new_tasks(spark, sf), _existing(spark, sf), X.schedule(spark), X.NOW)
    return b.select("type_key", "base", "batch_size", "gap_seconds", "pause_state")


@_query(f"""with {_BASES}, k as (select tax_code as type_key, company_id, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company)
select k.type_key, company_id as task_index, cast(base + (k // batch_size) * gap_seconds as double) as schedule_order, case when pause_state = 'paused' then 'Paused' else 'Pending' end as state from k join ba using (type_key)""")
def stamp_schedule(spark, sf):
    out = stamp.stamp(_new_tasks(spark, sf), _existing(spark, sf), X.schedule(spark), X.NOW, "task_index")
    return out.select("type_key", "task_index", "schedule_order", "state")


@_query(f"""with {_BASES}, k as (select tax_code as type_key, company_id, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company)
select k.type_key, cast(base + (k // batch_size) * gap_seconds as double) as schedule_order, count(*) as tasks from k join ba using (type_key) group by all""")
def stamp_slot_counts(spark, sf):
    return stamp_schedule(spark, sf).groupBy("type_key", "schedule_order").agg(F.count(F.lit(1)).alias("tasks"))


@_query(f"with {_BASES} select type_key, case when pause_state = 'paused' then 'Paused' else 'Pending' end as state, count(*) as tasks from ba join fx_company on tax_code = type_key group by all")
def state_on_insert(spark, sf):
    return stamp_schedule(spark, sf).groupBy("type_key", "state").agg(F.count(F.lit(1)).alias("tasks"))


@_query("""with d as (select * from fx_schedule where type_key = '__default__')
select t.type_key, coalesce(s.batch_size, d.batch_size) as batch_size, coalesce(s.gap_seconds, d.gap_seconds) as gap_seconds, coalesce(s.max_attempts, d.max_attempts) as max_attempts, coalesce(s.pause_state, 'active') as pause_state
from (select distinct type_key from fx_task) t left join fx_schedule s using (type_key) cross join d""")
def config_fallback(spark, sf):
    out = stamp.with_schedule(X.task(spark, sf).select("type_key").distinct(), X.schedule(spark))
    return out.select("type_key", "batch_size", "gap_seconds", "max_attempts", "pause_state")


@_query("""with t as (select tax_code, group_id, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company where tax_code in ('AUTOMOBILE', 'BUILDING'))
select tax_code as type_key, cast(946684800.0 + (k // 1000) * 1.0 as double) as schedule_order, count(*) as tasks from t where tax_code = 'AUTOMOBILE' group by all
union all select tax_code, cast(946684800.0 + (k // 10) * 3.0 as double), count(*) from t where tax_code = 'BUILDING' group by all""")
def fanout_multi_type(spark, sf):
    new = _new_tasks(spark, sf).where("type_key in ('AUTOMOBILE', 'BUILDING')")
    none = _existing(spark, sf).limit(0)
    out = stamp.stamp(new, none, X.schedule(spark), X.NOW, "task_index")
    return out.groupBy("type_key", "schedule_order").agg(F.count(F.lit(1)).alias("tasks"))


@_query("""with a as (select company_id, row_number() over (order by company_id) - 1 as k from fx_company where tax_code = 'BUILDING' and group_id < 2),
b as (select company_id, row_number() over (order by company_id) - 1 as k from fx_company where tax_code = 'BUILDING' and group_id >= 2), n as (select count(*) as n from a)
select 1 as spec, company_id as task_index, cast(946684800.0 + (k // 10) * 3.0 as double) as schedule_order from a
union all select 2, company_id, cast(946684800.0 + (case when n = 0 then 0 else ((n - 1) // 10) * 3.0 + 3.0 end) + (k // 10) * 3.0 as double) from b cross join n""")
def fanout_two_specs_append(spark, sf):
    c = X.company(spark, sf).where("tax_code = 'BUILDING'")
    kind = [F.lit(1).cast("bigint").alias("job_id"), F.col("tax_code").alias("type_key"), F.col("company_id").alias("task_index")]
    one, two = c.where("group_id < 2").select(*kind), c.where("group_id >= 2").select(*kind)
    none = _existing(spark, sf).limit(0)
    first = stamp.stamp(one, none, X.schedule(spark), X.NOW, "task_index")
    second = stamp.stamp(two, first.select(*none.columns), X.schedule(spark), X.NOW, "task_index")
    cols = ["task_index", "schedule_order"]
    return first.select(F.lit(1).alias("spec"), *cols).unionByName(second.select(F.lit(2).alias("spec"), *cols))


@_query("select 'empty' as id, 'Completed' as status, cast(0 as bigint) as task_count")
def fanout_born_complete(spark, sf):
    tasks = fanout.one_to_one(X.company(spark, sf), "tax_code = 'NONE'")
    n = tasks.agg(F.count(F.lit(1)).alias("task_count"))
    return n.select(F.lit("empty").alias("id"), F.when(F.col("task_count") == 0, S.COMPLETED).otherwise(S.ACTIVE).alias("status"), "task_count")


@_query("""select cast(r_regionkey as bigint) as job_id, 'group-' || r_regionkey as parent_task_id, to_json({'companyId': company_id, 'groupId': group_id})::varchar as payload from region join fx_company on group_id = r_regionkey where r_regionkey <> 4""")
def expand_children(spark, sf):
    r = X.table(spark, sf, "region")
    state = F.when(F.col("r_regionkey") == 4, S.SUCCEEDED).otherwise(S.RUNNING)
    parents = r.select(F.col("r_regionkey").cast("bigint").alias("job_id"), F.concat(F.lit("group-"), F.col("r_regionkey").cast("string")).alias("id"), state.alias("state"), F.col("r_regionkey").alias("group_id"))
    return fanout.expand(parents, X.company(spark, sf), ["group_id"], F.col("company_id").alias("companyId"), F.col("group_id").alias("groupId"))


# -- claim --------------------------------------------------------------------------------------------------------

_ELIGIBLE = f"el as (select * from fx_task where state = 'Pending' and (next_attempt_at is null or next_attempt_at <= {_NOW}) and type_key not in (select type_key from fx_schedule where pause_state = 'paused'))"
_TOP = "order by schedule_order, created_at, task_index, id"


@_query(f"with {_ELIGIBLE} select id, 'Running' as state, attempt + 1 as attempt, 'me' as claimed_by, {_NOW} as claimed_at from el {_TOP} limit 128")
def claim_topk(spark, sf):
    out = claim.claim(X.task(spark, sf), X.schedule(spark), X.NOW, 128, "me")
    return out.select("id", "state", "attempt", "claimed_by", "claimed_at").withColumns(_ntz("claimed_at"))


@_query(f"with {_ELIGIBLE} select type_key, count(*) as tasks from el group by 1")
def claim_paused_skip(spark, sf):
    return claim.eligible(X.task(spark, sf), X.schedule(spark), X.NOW).groupBy("type_key").agg(F.count(F.lit(1)).alias("tasks"))


@_query(f"with {_ELIGIBLE} select next_attempt_at is null as undelayed, count(*) as tasks from el group by 1")
def claim_backoff(spark, sf):
    e = claim.eligible(X.task(spark, sf), X.schedule(spark), X.NOW)
    return e.groupBy(F.col("next_attempt_at").isNull().alias("undelayed")).agg(F.count(F.lit(1)).alias("tasks"))


@_query(f"with {_ELIGIBLE}, r as (select id, row_number() over ({_TOP}) - 1 as rn from el) select id, 'w' || (rn % 3) as claimed_by from r where rn < 120")
def claim_multi_owner(spark, sf):
    return claim.claim_for(X.task(spark, sf), X.schedule(spark), X.NOW, 40, ["w0", "w1", "w2"]).select("id", "claimed_by")


@_query(f"""with {_ELIGIBLE}, c as (select * from el {_TOP} limit 100), d as (select * from fx_schedule where type_key = '__default__')
select c.id, j.type as job_type, j.name as job_payload, coalesce(s.max_attempts, d.max_attempts) as max_attempts from c join fx_job j on j.id = c.job_id left join fx_schedule s on s.type_key = c.type_key cross join d""")
def claim_with_context(spark, sf):
    c = claim.claim(X.task(spark, sf), X.schedule(spark), X.NOW, 100, "me")
    jobs = X.job(spark, sf).withColumn("payload", F.col("name"))
    return claim.with_context(c, jobs, X.schedule(spark)).select("id", "job_type", "job_payload", "max_attempts")


_FAIR = """with t as (select company_id, tax_code, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company where tax_code in ('BUILDING', 'AUTOMOBILE')),
s as (select *, (k // case when tax_code = 'BUILDING' then 15 else 5 end) as slot from t), f as (select * from s order by slot, tax_code, company_id limit 200)
select tax_code as type_key, count(*) as claimed from f group by 1"""


@_query(_FAIR)
def fair_share_interleave(spark, sf):
    rows = [("__default__", 1000, 1.0, 5, "active"), ("BUILDING", 15, 1.0, None, "active"), ("AUTOMOBILE", 5, 1.0, None, "active")]
    sch = spark.createDataFrame(rows, S.SCHEDULE)
    new = _new_tasks(spark, sf).where("type_key in ('BUILDING', 'AUTOMOBILE')")
    tasks = stamp.stamp(new, _existing(spark, sf).limit(0), sch, X.NOW, "task_index")
    first = tasks.orderBy("schedule_order", "type_key", "task_index").limit(200)
    return first.groupBy("type_key").agg(F.count(F.lit(1)).alias("claimed"))


@_query("select instance_id, last_seen_at, executing from fx_heartbeat where instance_id not in ('u1') union all select 'u1', timestamp '2024-02-01 00:00:00', 7 union all select 'new', timestamp '2024-02-01 00:00:00', 1")
def heartbeat_upsert(spark, sf):
    new = spark.createDataFrame([("u1", X.EVENTS_NOW, 7), ("new", X.EVENTS_NOW, 1)], S.HEARTBEAT)
    old = X.heartbeat(spark, sf).withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    return claim.beat(old, new).withColumns(_ntz("last_seen_at"))


# -- settlement ---------------------------------------------------------------------------------------------------


def _outcomes(spark, sf, succeed: bool):
    """Outcomes of running tasks: of one in two, some from an earlier attempt."""
    t = X.task(spark, sf).where("state = 'Running'")
    mine = t.where("job_id % 2 = 0" if succeed else "job_id % 2 = 1")
    late = F.col("job_id") % 5 == 0
    return mine.select(F.col("id").alias("task_id"), (F.col("attempt") - late.cast("int")).alias("attempt"), F.col("claimed_at").alias("started_at"), F.lit(X.NOW).cast("timestamp_ntz").alias("ended_at"))


@_query("select id, attempt, 'Succeeded' as state, timestamp '2000-01-01 00:00:00' as completed_at from fx_task where state = 'Running' and job_id % 2 = 0 and job_id % 5 <> 0 and claimed_by = 'inst-1'")
def settle_complete_fenced(spark, sf):
    out = settle.complete(X.task(spark, sf), _outcomes(spark, sf, True), X.NOW, "inst-1")
    return out.select("id", "attempt", "state", "completed_at").withColumns(_ntz("completed_at"))


@_query(f"""with d as (select * from fx_schedule where type_key = '__default__'),
f as (select t.*, coalesce(s.max_attempts, d.max_attempts) as most, s.pause_state from fx_task t left join fx_schedule s using (type_key) cross join d where state = 'Running' and job_id % 2 = 1 and job_id % 5 <> 0)
select id, attempt, case when attempt >= most then 'Failed' when pause_state = 'paused' then 'Paused' else 'Pending' end as state,
    case when attempt < most then {_NOW} + to_milliseconds(cast(least(2000 * pow(2, greatest(0, attempt - 1)), 300000) as bigint)) end as next_attempt_at from f""")
def settle_fail_retry(spark, sf):
    out = settle.fail(X.task(spark, sf), _outcomes(spark, sf, False), X.schedule(spark), X.NOW)
    return out.select("id", "attempt", "state", "next_attempt_at").withColumns(_ntz("next_attempt_at"))


@_query("select id, attempt from fx_task where state = 'Running' and job_id % 2 = 0 and job_id % 5 <> 0")
def settle_duplicate_attempts(spark, sf):
    o = _outcomes(spark, sf, True)
    older = o.withColumn("attempt", F.col("attempt") - 1)
    return settle.complete(X.task(spark, sf), o.unionByName(o).unionByName(older), X.NOW).select("id", "attempt").dropDuplicates()


@_query("""with d as (select * from fx_schedule where type_key = '__default__')
select id, attempt, case when job_id % 3 <> 0 then 'Succeeded' when attempt >= coalesce(s.max_attempts, d.max_attempts) then 'Failed' when s.pause_state = 'paused' then 'Paused' else 'Pending' end as state
from fx_task t left join fx_schedule s using (type_key) cross join d where state = 'Running'""")
def settle_mixed_batch(spark, sf):
    """Every running attempt reports a success and a failure; the failure ended first in one job of three."""
    ran = X.task(spark, sf).where("state = 'Running'").select(F.col("id").alias("task_id"), "attempt", F.col("claimed_at").alias("started_at"), "job_id")
    early = F.when(F.col("job_id") % 3 == 0, 1).otherwise(0)
    good = ran.withColumns({"ended_at": F.lit(X.NOW), "failed": F.lit(False)})
    bad = ran.withColumns({"ended_at": F.lit(X.NOW) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), early), "failed": F.lit(True)})
    done, again = settle.settled(X.task(spark, sf), good.unionByName(bad).drop("job_id"), X.schedule(spark), X.NOW)
    return done.select("id", "attempt", "state").unionByName(again.select("id", "attempt", "state"))


@_query("""with c as (select tax_code, count(*) as n from fx_company group by 1), k as (select sum(n) as m from c), o as (select i // 1000 as slot, count(*) as n from (select unnest(range((select m from k)::bigint)) as i) group by 1)
select 'payload' as what, tax_code as name, n as tasks, n as ids from c union all select 'slot', slot::varchar, n, n from o""")
def dispatch_repeated_payloads(spark, sf):
    """Payloads that many rows share, through the engine: every row becomes a task with an id and a place of its own."""
    e = Engine(spark, new_path(spark, "engine"))
    e.create("taxes", "t").add_tasks("k", X.company(spark, sf).select(F.col("tax_code").alias("payload"))).dispatch(X.NOW)
    tasks = e.store.table("task")
    slot = (F.col("schedule_order") - X.EPOCH).cast("bigint").cast("string")
    numbers = F.count(F.lit(1)).alias("tasks"), F.count_distinct("id").alias("ids")
    by = lambda what, key: tasks.groupBy(key.alias("name")).agg(*numbers).select(F.lit(what).alias("what"), "name", "tasks", "ids")
    return by("payload", F.col("payload")).unionByName(by("slot", slot))


@_query("select distinct l_linenumber as attempt, cast(least(2000 * pow(2, greatest(0, l_linenumber - 1)), 300000) as double) as delay_ms from lineitem")
def backoff_schedule(spark, sf):
    return X.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("delay_ms", scalars.backoff_ms(F.col("attempt")))


def _reported(spark, sf):
    """Attempts with targets n and n + 1, of which the report names the first if it failed or has props of one kind."""
    e = X.table(spark, sf, "events")
    targets = F.array(F.col("event_id").cast("string"), F.concat(F.lit("x"), F.col("event_id").cast("string")))
    first = F.array(F.col("event_id").cast("string"))
    item = lambda o, out: F.array(F.struct(F.lit(o).alias("outcome"), out.alias("output"), first.alias("targetIds")))
    none = F.lit(None).cast("array<struct<outcome:string,output:string,targetIds:array<string>>>")
    items = F.when(F.col("event_type") == "error", item("Failed", F.col("props"))).when(F.col("event_type") == "click", item("Succeeded", F.lit(None).cast("string"))).otherwise(none)
    return e.select("event_id", "event_type", "props", items.alias("items"), targets.alias("targets"))


@_query("""select event_id, event_type = 'error' as failed, case event_type when 'error' then 2 else 1 end as items,
    case event_type when 'error' then [event_id::varchar] else [event_id::varchar, 'x' || event_id] end as first_targets from events""")
def outcome_inference(spark, sf):
    r = _reported(spark, sf).withColumn("report", reports.resolve(F.col("items"), F.col("targets")))
    return r.select("event_id", reports.failed(F.col("report")).alias("failed"), F.size("report").alias("items"), F.col("report")[0]["targetIds"].alias("first_targets"))


@_query("select event_id, 'Failed' as outcome, 'ValueError: ' || props as output, [event_id::varchar, 'x' || event_id] as target_ids from events where event_type = 'error'")
def outcome_throw(spark, sf):
    r = _reported(spark, sf).where("event_type = 'error'")
    item = reports.thrown(F.concat(F.lit("ValueError: "), "props"), F.col("targets"))[0]
    return r.select("event_id", item["outcome"].alias("outcome"), item["output"].alias("output"), item["targetIds"].alias("target_ids"))


# -- recovery -----------------------------------------------------------------------------------------------------


def _beats(spark):
    rows = [("inst-0", X.NOW), ("inst-1", X.NOW - timedelta(seconds=16)), ("inst-2", X.NOW - timedelta(seconds=5)), ("inst-3", X.NOW - timedelta(hours=1)), ("idle", X.NOW - timedelta(hours=2))]
    return spark.createDataFrame([(i, t, 0) for i, t in rows], S.HEARTBEAT)


_RELEASED = f"""d as (select * from fx_schedule where type_key = '__default__'),
r as (select t.*, coalesce(s.max_attempts, d.max_attempts) as most, s.pause_state from fx_task t left join fx_schedule s using (type_key) cross join d where state = 'Running')"""
_STATE = "case when attempt >= most then 'Failed' when pause_state = 'paused' then 'Paused' else 'Pending' end as state"


@_query(f"with {_RELEASED} select id, {_STATE} from r where claimed_by in ('inst-1', 'inst-3')")
def recover_stale(spark, sf):
    return recover.stale(X.task(spark, sf), _beats(spark), X.schedule(spark), X.NOW, timedelta(seconds=15), "inst-0")[0].select("id", "state")


@_query(f"with {_RELEASED} select id, {_STATE} from r where claimed_by = 'inst-1' and claimed_at < {_NOW} - interval 30 seconds and job_id % 7 <> 0")
def recover_self(spark, sf):
    t = X.task(spark, sf)
    return recover.self_stranded(t, X.schedule(spark), X.NOW, timedelta(seconds=30), "inst-1", t.where("job_id % 7 = 0")).select("id", "state")


@_query("select instance_id, last_seen_at, executing from (values ('inst-0', timestamp '2000-01-01 00:00:00', 0), ('inst-1', timestamp '1999-12-31 23:59:44', 0), ('inst-2', timestamp '1999-12-31 23:59:55', 0), ('inst-3', timestamp '1999-12-31 23:00:00', 0)) t(instance_id, last_seen_at, executing)")
def heartbeat_remove(spark, sf):
    t = X.task(spark, sf)
    return recover.remove_instance(recover.remove_instance(_beats(spark), t, "idle"), t, "inst-1").withColumns(_ntz("last_seen_at"))


# -- pause --------------------------------------------------------------------------------------------------------

_MOVES = """mv as (select t.*, s.pause_state, s.batch_size, s.gap_seconds, case when s.pause_state = 'paused' then 'pause' else 'resume' end as direction, row_number() over (partition by t.type_key order by schedule_order, created_at, task_index, id) as r
    from fx_task t join fx_schedule s using (type_key) where (s.pause_state = 'paused' and t.state = 'Pending') or (s.pause_state like 'resuming%' and t.state = 'Paused')),
sl as (select direction, cast(ceil(greatest(1, floor(floor(600.0 / (select count(distinct direction) from mv)) / count(distinct type_key))) / 50) * 50 as bigint) as slice from mv group by 1)"""


@_query(f"with {_MOVES} select type_key, mv.direction, count(*) as moved from mv join sl using (direction) where r <= slice group by all")
def pause_reconcile_budget(spark, sf):
    m = pause.select_moves(X.task(spark, sf), X.schedule(spark), 50, 600)
    return m.groupBy("type_key", "direction").agg(F.count(F.lit(1)).alias("moved"))


@_query(f"with {_MOVES} select id, 'Pending' as state, cast(schedule_order as double) as schedule_order from mv join sl using (direction) where r <= slice and pause_state = 'resuming_asis'")
def resume_asis(spark, sf):
    out = pause.reconcile(X.task(spark, sf), X.schedule(spark), X.NOW, 50, 600)
    return out.where("type_key = '5-LOW|R'").select("id", "state", "schedule_order")


@_query(f"""with {_MOVES}, fr as (select greatest(946684800.0, min(schedule_order)) as frontier from fx_task where state = 'Pending')
select id, 'Pending' as state, cast(frontier + ((r - 1) // 50) * ((49 // 50 + 1) * 0.5) + (((r - 1) % 50) // 50) * 0.5 as double) as schedule_order from mv join sl using (direction) cross join fr where r <= slice and pause_state = 'resuming_rebase'""")
def resume_rebase(spark, sf):
    out = pause.reconcile(X.task(spark, sf), X.schedule(spark), X.NOW, 50, 600)
    return out.where("type_key = '4-NOT SPECIFIED|R'").select("id", "state", "schedule_order")


@_query("""select type_key, batch_size, gap_seconds, max_attempts, case type_key when '1-URGENT|N' then 'paused' when '3-MEDIUM|N' then 'resuming_asis' else pause_state end as pause_state from fx_schedule
union all select 'NEW|TYPE', null, null, null, 'paused'""")
def pause_resume_flip(spark, sf):
    s = pause.pause(pause.pause(X.schedule(spark), "1-URGENT|N"), "NEW|TYPE")
    return pause.resume(s, "3-MEDIUM|N", rebase=False)


# -- statistics ---------------------------------------------------------------------------------------------------

_REFRESH = """c as (select job_id, count(*) filter (where state = 'Pending') as pending, count(*) filter (where state = 'Running') as running, count(*) filter (where state = 'Paused') as paused, count(*) filter (where state = 'Failed') as failed, count(*) as n from fx_task group by 1),
j as (select id, coalesce(pending, 0) as pending, coalesce(running, 0) as running, coalesce(paused, 0) as paused, coalesce(failed, 0) as failed, task_count from fx_job left join c on c.job_id = id where status = 'Active'),
s as (select *, task_count > 0 and pending + running + paused = 0 as done from j)"""


def _refreshed(spark, sf):
    t = X.task(spark, sf)
    jobs = X.job(spark, sf).withColumns({c: F.lit(0).cast("bigint") for c in ("pending", "running", "paused", "failed")}).withColumn("refreshed_at", F.lit(None).cast("timestamp"))
    return stats.refresh(jobs, t, X.NOW)


@_query(f"with {_REFRESH} select id, pending, running, paused, failed, case when done and failed > 0 then 'Faulted' when done then 'Completed' else 'Active' end as status, case when done then {_NOW} end as completed_at from s")
def refresh_stats(spark, sf):
    r = _refreshed(spark, sf).where("refreshed_at is not null")
    return r.select("id", "pending", "running", "paused", "failed", "status", "completed_at").withColumns(_ntz("completed_at"))


@_query(f"with {_REFRESH} select case when done and failed > 0 then 'Faulted' when done then 'Completed' else 'Active' end as status, count(*) as jobs from s group by 1")
def job_status(spark, sf):
    return _refreshed(spark, sf).where("refreshed_at is not null").groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


@_query(f"with {_REFRESH} select id, cast(greatest(0, task_count - pending - running - paused - failed) as bigint) as succeeded from s union all select id, cast(0 as bigint) from fx_job where status <> 'Active'")
def succeeded_derived(spark, sf):
    c = [F.col(x) for x in ("refreshed_at", "task_count", "pending", "running", "paused", "failed")]
    return _refreshed(spark, sf).select("id", scalars.succeeded(*c).alias("succeeded"))


# -- reports ------------------------------------------------------------------------------------------------------

_ITEMS = "it as (select cast(ts as date) as job_id, case event_type when 'error' then 'Failed' when 'signup' then 'Abandoned' else 'Succeeded' end as outcome, case when event_type = 'error' then props end as output, case when event_type = 'signup' then null else event_id::varchar end as target_id, event_id from events)"
_CHUNKS = f"{_ITEMS}, n as (select *, (row_number() over (partition by job_id order by outcome nulls last, output nulls last, target_id nulls last, event_id) - 1) // 100 as chunk_index from it)"


def _report_attempts(spark, sf):
    e = X.table(spark, sf, "events")
    outcome = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "signup", "Abandoned").otherwise("Succeeded")
    output = F.when(F.col("event_type") == "error", F.col("props"))
    targets = F.when(F.col("event_type") == "signup", F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string")))
    item = F.struct(outcome.alias("outcome"), output.alias("output"), targets.alias("targetIds"))
    return e.select(F.col("ts").cast("date").alias("job_id"), F.array(item).alias("report"))


@_query(f"with {_ITEMS} select job_id, outcome, output, target_id from it")
def report_explode(spark, sf):
    return compact.exploded(_report_attempts(spark, sf))


@_query(f"with {_CHUNKS} select job_id, cast(chunk_index as int) as chunk_index, cast(count(target_id) as int) as target_count, cast(count(distinct outcome || coalesce('=' || output, '')) as int) as items from n group by 1, 2")
def report_chunks(spark, sf):
    c = compact.chunks(compact.exploded(_report_attempts(spark, sf)), 100)
    return c.select("job_id", "chunk_index", "target_count", F.size("items").alias("items"))


@_query(f"with {_CHUNKS} select job_id, cast(chunk_index as int) as chunk_index, outcome, output, coalesce(list(target_id order by target_id) filter (where target_id is not null), []) as target_ids from n group by 1, 2, 3, 4")
def report_targetless(spark, sf):
    r = compact.read_report(compact.chunks(compact.exploded(_report_attempts(spark, sf)), 100))
    return r.select("job_id", "chunk_index", "outcome", "output", F.col("targetIds").alias("target_ids"))


@_query(f"""with {_CHUNKS}, g as (select job_id, chunk_index, outcome, output, coalesce(list(target_id order by target_id) filter (where target_id is not null), []) as ids from n group by 1, 2, 3, 4)
select job_id, cast(chunk_index as int) as chunk_index, outcome || ',' || coalesce('"' || replace(output, '"', '""') || '"', '') || ',' || len(ids) || ',"' || array_to_string(ids, ';') || '"' as line from g""")
def report_csv(spark, sf):
    r = compact.read_report(compact.chunks(compact.exploded(_report_attempts(spark, sf)), 100))
    return reports.csv_lines(r).select("job_id", "chunk_index", "line")


@_query("select job_id, cast(round(avg(duration_ms)) as bigint) as avg_duration_ms, count(duration_ms) as sample_count from fx_attempt where outcome = 'Succeeded' group by 1")
def attempt_rollup(spark, sf):
    return compact.job_means(X.attempt(spark, sf))


@_query("""with t as (select distinct user_id as id, cast(ts as date) as job_id, 'k' || (user_id % 4) as type_key from events)
select t.job_id, t.type_key, count(*) filter (where a.attempt > 1) / count(distinct t.id)::double as rate from t left join fx_attempt a on a.task_id = t.id and a.job_id = t.job_id group by 1, 2""")
def retry_rate(spark, sf):
    e = X.table(spark, sf, "events")
    day = F.col("ts").cast("date")
    key = lambda user, d: F.concat_ws("@", user.cast("string"), d.cast("string"))
    tasks = e.select(key(F.col("user_id"), day).alias("id"), day.alias("job_id"), F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")).alias("type_key")).distinct()
    att = X.attempt(spark, sf).select(key(F.col("task_id"), F.col("job_id")).alias("task_id"), "attempt")
    return compact.retry_rates(tasks, att)


_WAVES = "w as (select type_key, job_id, count(*) as n, avg(duration_ms) as m from fx_attempt where outcome <> 'Abandoned' group by 1, 2), a as (select *, row_number() over (partition by type_key order by job_id desc) - 1 as age from w)"


@_query(f"with {_WAVES} select type_key, round(sum(pow(0.8, age) * n * m) / sum(pow(0.8, age) * n), 6) as avg_ms, round(sum(pow(0.8, age) * n), 6) as weight, cast(sum(n) as bigint) as sample_count from a group by 1")
def type_ewma(spark, sf):
    means = X.attempt(spark, sf).where("outcome <> 'Abandoned'").groupBy("type_key", "job_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"))
    out = compact.weighted_ewma(means, "type_key", F.col("job_id"), "n", "m")
    return out.select("type_key", F.round("avg_ms", 6).alias("avg_ms"), F.round("weight", 6).alias("weight"), "sample_count")


@_query("""with w as (select type_key, job_id, count(*) filter (where attempt > 1) / count(*)::double as r from fx_attempt group by 1, 2),
i as (select *, row_number() over (partition by type_key order by job_id) as i, count(*) over (partition by type_key) as n from w)
select type_key, round(sum(case when i = 1 then pow(0.8, n - 1) * r else 0.2 * pow(0.8, n - i) * r end), 6) as avg_retry_rate from i group by 1""")
def retry_ewma(spark, sf):
    means = X.attempt(spark, sf).groupBy("type_key", "job_id").agg((F.count_if(F.col("attempt") > 1) / F.count(F.lit(1))).alias("r"))
    out = compact.rate_ewma(means, "type_key", F.col("job_id"), "r")
    return out.select("type_key", F.round("avg_retry_rate", 6).alias("avg_retry_rate"))


_KEEP = Retention(timedelta(days=90), {"1-URGENT": timedelta(days=365), "5-LOW": None})


@_query("select id, completed_at + case type when '1-URGENT' then interval 365 days when '5-LOW' then null else interval 90 days end as expire_at from fx_job")
def retention_expiry(spark, sf):
    return compact.expiry(X.job(spark, sf), _KEEP).select("id", "expire_at").withColumns(_ntz("expire_at"))


@_query(f"with e as (select id, completed_at + case type when '1-URGENT' then interval 365 days when '5-LOW' then null else interval 90 days end as expire_at from fx_job) select id, expire_at from e where expire_at < {_NOW} order by expire_at, id limit 200")
def purge_candidates(spark, sf):
    return compact.purgeable(compact.expiry(X.job(spark, sf), _KEEP), X.NOW, 200).select("id", "expire_at").withColumns(_ntz("expire_at"))


@_query("select id, completed_at from fx_job where status <> 'Active' order by completed_at, id limit 50")
def compact_ready(spark, sf):
    return compact.ready(X.job(spark, sf).withColumn("compacted_at", F.lit(None).cast("timestamp")), 50).select("id", "completed_at")


# -- reads --------------------------------------------------------------------------------------------------------


@_query("select id, type, status, created_at from fx_job order by created_at desc, id limit 50")
def jobs_list(spark, sf):
    return reads.jobs_list(X.job(spark, sf)).select("id", "type", "status", "created_at")


@_query("select id, type, status from fx_job where status = 'Active' and created_at >= timestamp '1997-01-01' and created_at < timestamp '1998-01-01' and (name ilike '%hig%' or type ilike '%hig%')")
def jobs_filter_search(spark, sf):
    return reads.jobs_filter(X.job(spark, sf), S.ACTIVE, datetime(1997, 1, 1), datetime(1998, 1, 1), "hig").select("id", "type", "status")


@_query("select count(*) as total, count(*) filter (where status = 'Active') as active, count(*) filter (where status = 'Completed') as completed, count(*) filter (where status = 'Faulted') as faulted from fx_job")
def jobs_stats(spark, sf):
    return reads.jobs_stats(X.job(spark, sf))


@_query("select id, cast(round(epoch_us(completed_at) / 1000.0 - epoch_us(created_at) / 1000.0) as bigint) as duration_ms, case when completed_at > created_at then cast(round(task_count * 1000000.0 / (epoch_us(completed_at) - epoch_us(created_at))) as bigint) end as throughput from fx_job")
def job_detail(spark, sf):
    return reads.job_detail(X.job(spark, sf)).select("id", "duration_ms", "throughput")


_COUNTS = "count(*) as total, count(*) filter (where status = 'Active') as active, count(*) filter (where status = 'Completed') as completed, count(*) filter (where status = 'Faulted') as faulted"


@_query(f"select strftime(created_at, '%Y-%m-%d') as day, {_COUNTS} from fx_job where created_at >= {_NOW} - interval 365 days group by 1")
def activity_by_day(spark, sf):
    return reads.activity(X.job(spark, sf), X.NOW)


def _event_jobs(spark, sf):
    status = F.when(F.col("event_type") == "error", S.FAULTED).when(F.col("event_type") == "view", S.ACTIVE).otherwise(S.COMPLETED)
    return X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"), F.col("event_type").alias("name"), F.col("event_type").alias("type"))


_EVENT_JOBS = "ej as (select event_id as id, ts as created_at, case event_type when 'error' then 'Faulted' when 'view' then 'Active' else 'Completed' end as status from events)"

for _unit in ("year", "day", "hour", "minute", "second"):
    _range = "" if _unit in ("year", "day") else " where created_at >= timestamp '2024-01-10' and created_at < timestamp '2024-01-11'"

    def _hist(spark, sf, unit=_unit, limited=bool(_range)):
        span = (datetime(2024, 1, 10), datetime(2024, 1, 11)) if limited else (None, None)
        return reads.histogram(_event_jobs(spark, sf), unit, "UTC", *span)

    _query(f"with {_EVENT_JOBS} select date_trunc('{_unit}', created_at)::timestamp as bucket, {_COUNTS} from ej{_range} group by 1", f"histogram_{_unit}")(_hist)


@_query(f"with {_EVENT_JOBS} select date_trunc('day', (created_at at time zone 'UTC') at time zone 'America/New_York')::timestamp as bucket, {_COUNTS} from ej group by 1")
def histogram_tz(spark, sf):
    return reads.histogram(_event_jobs(spark, sf), "day", "America/New_York")


@_query(f"with {_EVENT_JOBS}, h as (select hour(created_at) as hour, {_COUNTS} from ej where created_at >= timestamp '2024-01-10' and created_at < timestamp '2024-01-11' group by 1) select cast(i as int) as hour, coalesce(total, 0) as total, coalesce(active, 0) as active, coalesce(completed, 0) as completed, coalesce(faulted, 0) as faulted from range(24) r(i) left join h on h.hour = i")
def grid_hours(spark, sf):
    day = datetime(2024, 1, 10)
    return reads.grid_hours(reads.histogram(_event_jobs(spark, sf), "hour", "UTC", day, day + timedelta(days=1)), day)


@_query(f"with {_EVENT_JOBS}, h as (select date_trunc('day', created_at)::date as d, count(*) as total from ej group by 1) select cast(i as int) as cell, strftime(date '2024-01-29' + i::int, '%Y-%m-%d') as day, (date '2024-01-29' + i::int) between date '2024-02-01' and date '2024-02-29' as in_month, case when (date '2024-01-29' + i::int) between date '2024-02-01' and date '2024-02-29' then coalesce(total, 0) else 0 end as total from range(35) r(i) left join h on h.d = date '2024-01-29' + i::int")
def grid_month(spark, sf):
    return reads.grid_month(reads.histogram(_event_jobs(spark, sf), "day"), 2024, 2)


@_query(f"with {_EVENT_JOBS} select {_COUNTS} from ej")
def range_totals(spark, sf):
    return reads.range_totals(reads.histogram(_event_jobs(spark, sf), "day"))


@_query(f"with {_EVENT_JOBS}, h as (select date_trunc('day', created_at)::timestamp as bucket, count(*) as total from ej group by 1) select bucket, total, cast(greatest(2, floor(total * 100.0 / (select max(total) from h) + 0.5)) as int) as pct from h")
def histogram_bars(spark, sf):
    return reads.bars(reads.histogram(_event_jobs(spark, sf), "day"))


@_query(f"with {_REFRESH} select id, case when failed > 0 then 'faulted' when running > 0 then 'running' else 'ok' end as severity, cast(case when pending <= 0 then 0 when pending <= 2 then 1 when pending <= 5 then 2 when pending <= 10 then 3 else 4 end as int) as level from s")
def severity_level(spark, sf):
    r = _refreshed(spark, sf).where("refreshed_at is not null")
    return r.select("id", scalars.severity(F.col("failed"), F.col("running")).alias("severity"), scalars.level(F.col("pending")).alias("level"))


@_query(f"""with {_WAVES}, m as (select type_key, cast(sum(n) as bigint) as sample_count, sum(pow(0.8, age) * n * m) / sum(pow(0.8, age) * n) as avg_ms from a group by 1)
select coalesce(s.type_key, m.type_key) as type_key, batch_size, gap_seconds, max_attempts, batch_size / gap_seconds as share, sample_count, cast(round_even(avg_ms, 0) as bigint) as avg_ms from fx_schedule s full outer join m on m.type_key = s.type_key""")
def type_metrics_full_outer(spark, sf):
    means = X.attempt(spark, sf).where("outcome <> 'Abandoned'").groupBy("type_key", "job_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"))
    m = compact.weighted_ewma(means, "type_key", F.col("job_id"), "n", "m").withColumns({"avg_wait_ms": F.lit(None).cast("double"), "avg_retry_rate": F.lit(None).cast("double")})
    return reads.type_metrics(X.schedule(spark), m).drop("avg_wait_ms", "avg_retry_rate", "pause_state")


@_query("select instance_id, executing, cast(round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(last_seen_at)) / 1000000.0) as bigint) as age_seconds, round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(last_seen_at)) / 1000000.0) <= 86400 * 2 as live from fx_heartbeat")
def cluster_liveness(spark, sf):
    return reads.cluster(X.heartbeat(spark, sf), X.EVENTS_NOW, 2 * 86400).drop("last_seen_at")


@_query("with a as (select executing, round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(last_seen_at)) / 1000000.0) <= 86400 * 2 as live from fx_heartbeat) select cast(coalesce(sum(executing) filter (where live), 0) as bigint) as executing, count(*) filter (where live) as instances from a")
def cluster_executing(spark, sf):
    return reads.executing_total(X.heartbeat(spark, sf), X.EVENTS_NOW, 2 * 86400)


@_query("""with k as (select distinct tax_code as type_key from fx_company union select type_key from fx_schedule where type_key <> '__default__'), d as (select * from fx_schedule where type_key = '__default__')
select k.type_key, s.batch_size, s.gap_seconds, s.max_attempts, coalesce(s.batch_size, d.batch_size) as effective_batch_size, coalesce(s.gap_seconds, d.gap_seconds) as effective_gap_seconds, coalesce(s.max_attempts, d.max_attempts) as effective_max_attempts,
coalesce(s.pause_state, 'active') as pause_state, s.batch_size is not null or s.gap_seconds is not null or s.max_attempts is not null as configured from k left join fx_schedule s using (type_key) cross join d""")
def settings_types(spark, sf):
    registry = X.company(spark, sf).select(F.col("tax_code").alias("type_key")).distinct()
    return reads.settings_types(registry, X.schedule(spark))


# -- sample handlers and sources ----------------------------------------------------------------------------------


@_query("select company_id, cast(round_even(revenue * 0.2, 2) as decimal(18,2)) as tax_due from fx_company")
def tax_recalc_corporate(spark, sf):
    rate = F.lit("0.2").cast("decimal(3,1)")
    return X.company(spark, sf).select("company_id", F.bround(F.col("revenue") * rate, 2).cast("decimal(18,2)").alias("tax_due"))


@_query("select company_id, cast(round_even(cast((company_id % 250) as decimal(9,0)) * 12.345, 2) as decimal(18,2)) as tax_due from fx_company")
def tax_recalc_employee(spark, sf):
    heads = (F.col("company_id") % 250).cast("decimal(9,0)")
    return X.company(spark, sf).select("company_id", F.bround(heads * F.lit("12.345").cast("decimal(5,3)"), 2).cast("decimal(18,2)").alias("tax_due"))


_CODE = "case when i < 1000 then 'TAX-1K' when i < 11000 then 'TAX-10K' when i < 111000 then 'TAX-100K' when i < 311000 then 'TAX-200K' when i < 711000 then 'TAX-400K' else 'BG-' || lpad(((i - 711000) % 500)::varchar, 4, '0') end"


@_query(f"select {_CODE} as tax_code, count(*) as entities from range(800000) r(i) group by 1")
def taxcode_plan(spark, sf):
    return spark.range(800_000).groupBy(scalars.tax_code(F.col("id")).alias("tax_code")).agg(F.count(F.lit(1)).alias("entities"))


@_query("""with t(code, expected) as (values ('BUILDING', 300), ('MACHINERY', 300), ('MISSING', 10)) select code, expected::bigint as expected, count(company_id) as actual from t left join fx_company on tax_code = code group by all""")
def tax_code_counts(spark, sf):
    want = spark.createDataFrame([("BUILDING", 300), ("MACHINERY", 300), ("MISSING", 10)], "code string, expected bigint")
    have = X.company(spark, sf).groupBy(F.col("tax_code").alias("code")).agg(F.count(F.lit(1)).alias("actual"))
    return want.join(have, "code", "left").fillna(0, ["actual"])


@_query("select cast(i * 1000 as bigint) as start_index, cast(least(1000, 12345 - i * 1000) as int) as count from range(13) r(i)")
def seed_batches(spark, sf):
    from fanloom.sources.adapters import seed_ranges

    return seed_ranges(spark, 12_345, 1000)


@_query("select quantile_disc(v, 0.1) as p10, avg(v) as mean, min(v) as low, max(v) as high, round(stddev_pop(v), 6) as sd, round(stddev_pop(v) / avg(v), 6) as cov from (select count(*) as v from events group by date_trunc('hour', ts))")
def saturation_stats(spark, sf):
    v = X.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts")).agg(F.count(F.lit(1)).alias("v"))
    return v.selectExpr("percentile_disc(0.1) within group (order by v) as p10", "avg(v) as mean", "min(v) as low", "max(v) as high", "round(stddev_pop(v), 6) as sd", "round(stddev_pop(v) / avg(v), 6) as cov").withColumn("p10", F.col("p10").cast("bigint"))


@_query("select event_type as type_key, min(ts) as first_at, max(ts) as last_at, count(*) filter (where ts between timestamp '2024-01-05' and timestamp '2024-01-20') as overlap from events group by 1")
def type_share(spark, sf):
    e = X.table(spark, sf, "events")
    inside = F.col("ts").between(F.lit(datetime(2024, 1, 5)), F.lit(datetime(2024, 1, 20)))
    return e.groupBy(F.col("event_type").alias("type_key")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(inside).alias("overlap"))


@_query("""with c as (select company_id, tax_code, revenue, row_number() over (partition by tax_code order by company_id) - 1 as k from fx_company where tax_code in ('BUILDING', 'AUTOMOBILE')),
s as (select *, 946684800.0 + case tax_code when 'BUILDING' then (k // 10) * 3.0 else (k // 1000) * 1.0 end as o from c), t as (select * from s order by o, tax_code, company_id limit 500)
select tax_code as type_key, count(*) as tasks, count(*) filter (where revenue >= 0) as succeeded, count(*) filter (where revenue < 0) as failed, cast(sum(case when revenue >= 0 then round_even(revenue * 0.2, 2) end) as decimal(28,2)) as tax_due from t group by 1""")
def lifecycle_summary(spark, sf):
    """Fan-out, stamping, claim, a column handler, settlement and a summary, in one lazy plan."""
    c = X.company(spark, sf).where("tax_code in ('BUILDING', 'AUTOMOBILE')")
    new = c.select(F.lit(1).cast("bigint").alias("job_id"), F.col("tax_code").alias("type_key"), F.col("company_id").alias("task_index"), F.col("company_id").cast("string").alias("id"), "revenue")
    tasks = stamp.stamp(new, _existing(spark, sf).limit(0), X.schedule(spark), X.NOW, "task_index")
    tasks = tasks.withColumns({"attempt": F.lit(0), "claimed_by": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("timestamp"), "next_attempt_at": F.lit(None).cast("timestamp"), "created_at": F.col("type_key")})
    claimed = claim.claim(tasks, X.schedule(spark), X.NOW, 500, "me")
    due = F.bround(F.col("revenue") * F.lit("0.2").cast("decimal(3,1)"), 2).cast("decimal(18,2)")
    done = claimed.withColumns({"tax_due": F.when(F.col("revenue") >= 0, due), "ok": F.col("revenue") >= 0})
    return done.groupBy("type_key").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tax_due").cast("decimal(28,2)").alias("tax_due")
    )


from fanloom.plans import catalogue_more  # noqa: E402, F401 (adds to QUERIES and ORACLES)
