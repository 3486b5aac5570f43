"""Read projections over the engine's tables: lists, details, calendars, metrics, settings."""

from __future__ import annotations

from dataclasses import fields
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fanloom import schema as S
from fanloom.config import EngineOptions

UNITS = ("year", "month", "day", "hour", "minute", "second")


def clamp(n: int | None, low: int, high: int, default: int) -> int:
    return default if n is None else max(low, min(high, n))


def jobs_filter(jobs: DataFrame, status: str | None = None, start: datetime | None = None, end: datetime | None = None, search: str | None = None) -> DataFrame:
    """Jobs of a status, created in [start, end), whose name or type has a text in it (case ignored; % and _ stand for
    any signs). What is None doesn't filter."""
    out = jobs
    if status is not None:
        out = out.where(F.col("status") == status)
    if start is not None:
        out = out.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("created_at") < F.lit(end))
    if search:
        like = f"%{search}%"
        out = out.where(F.col("name").ilike(like) | F.col("type").ilike(like))
    return out


def jobs_list(jobs: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """The newest jobs, at most 500."""
    return jobs_filter(jobs, **filters).orderBy(F.col("created_at").desc(), "id").limit(clamp(limit, 1, 500, 50))


def jobs_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (S.ACTIVE, S.COMPLETED, S.FAULTED)])


def job_detail(jobs: DataFrame) -> DataFrame:
    """Jobs with duration_ms and throughput (tasks a second), null until done or if no time passed."""
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    ms = F.round(micros / 1000).cast("bigint")
    rate = F.when(micros > 0, F.round(F.col("task_count") * 1e6 / F.nullif(micros, F.lit(0)))).cast("bigint")
    return jobs.withColumns({"duration_ms": ms, "throughput": rate})


def _by_status(n: Column | None = None) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (S.ACTIVE, S.COMPLETED, S.FAULTED)]]


def activity(jobs: DataFrame, now: datetime, days: int | None = None) -> DataFrame:
    """Jobs a day over the last days (1 to 366)."""
    start = now - timedelta(days=clamp(days, 1, 366, 365))
    rows = jobs.where(F.col("created_at") >= F.lit(start))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(*_by_status())


def histogram(jobs: DataFrame, unit: str, zone: str = "UTC", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Jobs a calendar unit of a time zone, buckets without jobs left out. created_at is in UTC."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    rows = jobs_filter(jobs, None, start, end)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("created_at").cast("timestamp_ntz"))
    return rows.groupBy(F.date_trunc(unit, local).cast("timestamp_ntz").alias("bucket")).agg(*_by_status())


def grid_hours(hist: DataFrame, day: datetime) -> DataFrame:
    """24 rows, hours without jobs with zeros."""
    hours = hist.sparkSession.range(24).select((F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("bucket"), F.col("id").cast("int").alias("hour"))
    return hours.join(hist, "bucket", "left").select("hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "active", "completed", "faulted")])


def grid_month(hist: DataFrame, year: int, month: int) -> DataFrame:
    """The cells of a month's page: whole weeks from Monday on, with the days of other months marked and empty."""
    first = datetime(year, month, 1)
    after = datetime(year + month // 12, month % 12 + 1, 1)
    begin = first - timedelta(days=first.weekday())
    cells = -(-(after - begin).days // 7) * 7
    grid = hist.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"), (F.lit(begin).cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("bucket"))
    inside = (F.col("bucket") >= F.lit(first).cast("timestamp_ntz")) & (F.col("bucket") < F.lit(after).cast("timestamp_ntz"))
    joined = grid.join(hist, "bucket", "left")
    return joined.select("cell", F.date_format("bucket", "yyyy-MM-dd").alias("day"), inside.alias("in_month"), F.when(inside, F.coalesce("total", F.lit(0))).otherwise(0).alias("total"))


def grid_year(hist: DataFrame, year: int) -> DataFrame:
    """12 rows of a histogram by month, months without jobs with zeros."""
    months = hist.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"), F.make_date(F.lit(year), F.col("id").cast("int"), F.lit(1)).cast("timestamp_ntz").alias("bucket"))
    return months.join(hist, "bucket", "left").select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "active", "completed", "faulted")])


def top(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """The first rows of an order, with their place from 1 on; only so many rows meet in one partition."""
    return df.orderBy(*order).limit(count).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def engine_info(spark: SparkSession, options: EngineOptions) -> DataFrame:
    """(name, value) of an engine's settings, in the order of names."""
    return spark.createDataFrame(sorted((f.name, str(getattr(options, f.name))) for f in fields(options)), "name string, value string")


def range_totals(hist: DataFrame) -> DataFrame:
    return hist.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "active", "completed", "faulted")])


def bars(hist: DataFrame) -> DataFrame:
    """Heights of a histogram's bars against the highest, in percent, 2 at least."""
    most = hist.agg(F.max("total").alias("most"))
    return hist.join(F.broadcast(most)).select("bucket", "total", F.greatest(F.lit(2), F.floor(F.col("total") * 100.0 / F.nullif("most", F.lit(0)) + 0.5)).cast("int").alias("pct"))


def drill(jobs: DataFrame, unit: str, start: datetime, end: datetime, most: int = 60) -> tuple[str, DataFrame]:
    """A range's jobs one by one (oldest first) if they are few, else a finer histogram. Counts no more than it must."""
    rows = jobs_filter(jobs, None, start, end)
    if rows.limit(most + 1).count() <= most:
        return "items", rows.orderBy("created_at", "id")
    return "buckets", histogram(rows, UNITS[min(UNITS.index(unit) + 1, len(UNITS) - 1)])


def type_metrics(schedule: DataFrame, metrics: DataFrame) -> DataFrame:
    """Schedules and metrics of all types that have either, with the share ``batch / gap`` of a type."""
    j = schedule.join(metrics, "type_key", "full_outer")
    share = F.when(F.col("gap_seconds") != 0, F.col("batch_size") / F.nullif("gap_seconds", F.lit(0.0)))
    return j.select(
        "type_key", "batch_size", "gap_seconds", "max_attempts", share.alias("share"), "sample_count",
        F.bround("avg_ms").cast("bigint").alias("avg_ms"), F.bround("avg_wait_ms").cast("bigint").alias("avg_wait_ms"), "avg_retry_rate",
    )


def cluster(heartbeats: DataFrame, now: datetime, stale: int = 30) -> DataFrame:
    """Instances with the seconds since they were seen, and whether they count as live."""
    age = F.round((F.unix_micros(F.lit(now)) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / 1e6).cast("bigint")
    return heartbeats.select("instance_id", "last_seen_at", "executing", age.alias("age_seconds"), (age <= stale).alias("live"))


def executing_total(heartbeats: DataFrame, now: datetime, stale: int = 30) -> DataFrame:
    live = cluster(heartbeats, now, stale)
    return live.agg(F.coalesce(F.sum(F.when(F.col("live"), F.col("executing"))), F.lit(0)).cast("bigint").alias("executing"), F.count_if("live").alias("instances"))


def settings_types(registry: DataFrame, schedule: DataFrame) -> DataFrame:
    """Every registered or configured type: its own values, effective values, whether any is its own, in key order."""
    keys = registry.select("type_key").unionByName(schedule.where(F.col("type_key") != S.DEFAULT_KEY).select("type_key")).distinct()
    own = keys.join(schedule, "type_key", "left")
    default = schedule.where(F.col("type_key") == S.DEFAULT_KEY).select(*[F.col(c).alias(f"d_{c}") for c in ("batch_size", "gap_seconds", "max_attempts")])
    values = ("batch_size", "gap_seconds", "max_attempts")
    return own.join(F.broadcast(default), how="left").select(
        "type_key",
        *values,
        *[F.coalesce(c, f"d_{c}").alias(f"effective_{c}") for c in values],
        F.coalesce("pause_state", F.lit("active")).alias("pause_state"),
        (F.col("batch_size").isNotNull() | F.col("gap_seconds").isNotNull() | F.col("max_attempts").isNotNull()).alias("configured"),
    ).orderBy("type_key")
