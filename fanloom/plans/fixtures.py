"""The engine's tables as views of the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2000, 1, 1)
EVENTS_NOW = datetime(2024, 2, 1)
EPOCH = 946684800.0

SCHEDULE_ROWS = [
    ("__default__", 1000, 1.0, 5, "active"),
    ("1-URGENT|N", 7, 2.5, 3, "active"),
    ("2-HIGH|N", 20, None, None, "active"),
    ("3-MEDIUM|N", None, None, None, "paused"),
    ("4-NOT SPECIFIED|R", 50, 0.5, None, "resuming_rebase"),
    ("5-LOW|R", None, 2.0, 2, "resuming_asis"),
    ("BUILDING", 10, 3.0, 4, "active"),
    ("MACHINERY", 5, 1.0, None, "paused"),
    ("FURNITURE", None, 0.25, 2, "resuming_asis"),
]

#: Rows that a task of the join behind ``task`` gets, both sides together; it sorts them, and counts by job keep a row for each job.
TASK_ROWS = 500_000


def _lit(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


SCHEDULE_SQL = "fx_schedule as (select type_key, batch_size::int as batch_size, gap_seconds::double as gap_seconds, max_attempts::int as max_attempts, pause_state from (values %s) t(type_key, batch_size, gap_seconds, max_attempts, pause_state))" % ", ".join(
    "(" + ", ".join(map(_lit, r)) + ")" for r in SCHEDULE_ROWS
)
COMPANY_SQL = "fx_company as (select c_custkey as company_id, c_name as name, c_mktsegment as tax_code, n_name as country, n_regionkey as group_id, cast(c_acctbal as decimal(18,2)) as revenue from customer join nation on c_nationkey = n_nationkey)"
JOB_SQL = """fx_job as (select o_orderkey as id, o_orderpriority as name, o_orderpriority as type, case o_orderstatus when 'O' then 'Active' when 'F' then 'Completed' else 'Faulted' end as status,
    o_orderdate as created_at, case when o_orderstatus <> 'O' then o_orderdate + to_hours((o_custkey % 72 + 1)::int) end as completed_at, (o_custkey % 9)::bigint as task_count from orders)"""
TASK_SQL = """fx_task as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) as id, l_orderkey as job_id, concat(o_orderpriority, '|', l_returnflag) as type_key,
    case when l_linestatus = 'O' then case l_returnflag when 'N' then 'Pending' when 'A' then 'Running' else 'Paused' end when l_returnflag = 'R' then 'Failed' else 'Succeeded' end as state,
    concat('inst-', l_suppkey % 4) as claimed_by, l_linenumber as attempt, greatest(l_shipdate, o_orderdate) as claimed_at, o_orderdate as created_at, l_linenumber::bigint as task_index,
    case when l_linenumber % 3 = 0 then l_shipdate end as next_attempt_at, 946600000.0 + (l_orderkey % 1000) + l_linenumber * 0.25 as schedule_order
    from lineitem join orders on l_orderkey = o_orderkey)"""
ATTEMPT_SQL = """fx_attempt as (select event_id as id, user_id as task_id, cast(ts as date) as job_id, event_type as type_key, cast(row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as int) as attempt,
    ts as started_at, cast(round(value * 100) as bigint) as duration_ms, case event_type when 'error' then 'Failed' when 'signup' then 'Abandoned' else 'Succeeded' end as outcome from events)"""
HEARTBEAT_SQL = "fx_heartbeat as (select concat('u', user_id) as instance_id, max(ts) as last_seen_at, cast(count(*) as int) as executing from events group by user_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parted(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join in as many partitions as their rows ask for, where that is more than Spark may be left with:
    a set number of shuffle partitions doesn't follow the input, and small ones are joined up to one a core. Beyond the
    number up to which shuffles are written without a sort in memory, a task gets up to three times its rows first. The
    counts read Parquet footers only."""
    spark = left.sparkSession
    rows = left.count() + right.count()
    unsorted = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    n = max(min(-(-rows // TASK_ROWS), unsorted), -(-rows // (3 * TASK_ROWS)))
    if n <= min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        return left, right
    return left.repartition(n, left_key), right.repartition(n, right_key)


def schedule(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """A local relation, whose size the optimizer knows."""
    values = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in SCHEDULE_ROWS)
    return spark.sql(f"select type_key, cast(batch_size as int), cast(gap_seconds as double), cast(max_attempts as int), pause_state from values {values} as t(type_key, batch_size, gap_seconds, max_attempts, pause_state)")


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tax_code"), F.col("n_name").alias("country"),
        F.col("n_regionkey").alias("group_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("revenue"),
    )


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 72 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Faulted")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderpriority").alias("type"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", done).alias("completed_at"), (F.col("o_custkey") % 9).alias("task_count"),
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _parted(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey")
    open_ = F.when(F.col("l_returnflag") == "N", "Pending").when(F.col("l_returnflag") == "A", "Running").otherwise("Paused")
    state = F.when(F.col("l_linestatus") == "O", open_).when(F.col("l_returnflag") == "R", "Failed").otherwise("Succeeded")
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", *keys, F.date_format("l_shipdate", "yyyyMMdd")).alias("id"), F.col("l_orderkey").alias("job_id"), F.concat("o_orderpriority", F.lit("|"), "l_returnflag").alias("type_key"),
        state.alias("state"), F.concat(F.lit("inst-"), (F.col("l_suppkey") % 4).cast("string")).alias("claimed_by"), F.col("l_linenumber").alias("attempt"),
        F.greatest("l_shipdate", "o_orderdate").alias("claimed_at"), F.col("o_orderdate").alias("created_at"), F.col("l_linenumber").cast("bigint").alias("task_index"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate")).alias("next_attempt_at"),
        (F.lit(946600000.0) + F.col("l_orderkey") % 1000 + F.col("l_linenumber") * 0.25).alias("schedule_order"),
    )


def attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    day = F.col("ts").cast("date")
    n = F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id"))
    outcome = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "signup", "Abandoned").otherwise("Succeeded")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), day.alias("job_id"), F.col("event_type").alias("type_key"), n.alias("attempt"), F.col("ts").alias("started_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"), outcome.alias("outcome"),
    )


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instance_id")).agg(F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).cast("int").alias("executing"))
