"""Scalar rules of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot_order(base: Column, k: Column, batch: Column, gap: Column) -> Column:
    """Order key of the k-th task (from 0): ``batch`` tasks share a slot, slots are ``gap`` apart."""
    return base + F.floor(k / batch).cast("double") * gap


def backoff_ms(attempt: Column, base_ms: int = 2000, most_ms: int = 300_000) -> Column:
    """Delay before the attempt after this one: doubles each time, up to a bound."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)), F.lit(float(most_ms)))


def duration_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds, never negative."""
    micros = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / 1000)).cast("bigint")


def wait_ms(since: Column, until: Column) -> Column:
    """Milliseconds between two times, null where one is."""
    return (F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1000.0


def axis_position(ts: Column, start, end) -> Column:
    """Place of a time on an axis from ``start`` to ``end``: 0 to 1, those outside at its ends."""
    at, a, b = (F.unix_micros(x.cast("timestamp")) for x in (ts, F.lit(start), F.lit(end)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - a) / F.nullif(b - a, F.lit(0))))


def after(ts: Column, secs: Column) -> Column:
    """The timestamp so many seconds later."""
    return F.timestamp_micros((F.unix_micros(ts.cast("timestamp")) + F.round(secs * 1e6)).cast("bigint"))


def succeeded(refreshed: Column, total: Column, pending: Column, running: Column, paused: Column, failed: Column) -> Column:
    """Tasks that succeeded: what is in no other state, 0 before the first refresh and never negative."""
    return F.when(refreshed.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), total - pending - running - paused - failed)).cast("bigint")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100.0 / F.nullif(total, F.lit(0)) + 0.5)).otherwise(0).cast("int")


def severity(failed: Column, running: Column) -> Column:
    return F.when(failed > 0, "faulted").when(running > 0, "running").otherwise("ok")


def level(count: Column) -> Column:
    return F.when(count <= 0, 0).when(count <= 2, 1).when(count <= 5, 2).when(count <= 10, 3).otherwise(4).cast("int")


TAX_BLOCKS = {"TAX-1K": 1_000, "TAX-10K": 10_000, "TAX-100K": 100_000, "TAX-200K": 200_000, "TAX-400K": 400_000}


def tax_code(index: Column) -> Column:
    """Code of an entity by its number: blocks of fixed sizes one after the other, then 500 further codes in turn."""
    last, out = 0, F.when(F.lit(False), F.lit(""))
    for code, size in TAX_BLOCKS.items():
        last += size
        out = out.when(index < last, F.lit(code))
    return out.otherwise(F.concat(F.lit("BG-"), F.lpad(((index - last) % 500).cast("string"), 4, "0")))


def error_chain(error: BaseException) -> str:
    """``Type: message`` of an error and its causes, outermost first."""
    parts, seen = [], set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        parts.append(f"{type(error).__name__}: {error}")
        error = error.__cause__ or (None if error.__suppress_context__ else error.__context__)
    return " -> ".join(parts)


def calendar_range(year: int, month: int | None = None, day: int | None = None, hour: int | None = None, minute: int | None = None, second: int | None = None):
    """(from, to, bucket): the half-open range of a calendar unit, and the unit of its buckets."""
    from datetime import datetime, timedelta

    if month is None:
        return datetime(year, 1, 1), datetime(year + 1, 1, 1), "day"
    if day is None:
        return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1), "day"
    if hour is None:
        return datetime(year, month, day), datetime(year, month, day) + timedelta(days=1), "hour"
    if minute is None:
        return datetime(year, month, day, hour), datetime(year, month, day, hour) + timedelta(hours=1), "minute"
    start = datetime(year, month, day, hour, minute)
    if second is None:
        return start, start + timedelta(minutes=1), "second"
    return start + timedelta(seconds=second), start + timedelta(seconds=second + 1), "second"
