"""Handlers of task types: column expressions, or Python run in Arrow batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom import schema as S
from fanloom.config import TypeSchedule
from fanloom.functions import reports
from fanloom.functions.scalars import error_chain


@dataclass(frozen=True)
class Context:
    """What a handler knows of its attempt."""

    job_id: str
    task_id: str
    type_key: str
    attempt: int
    max_attempts: int

    @property
    def last_attempt(self) -> bool:
        return self.attempt >= self.max_attempts


@dataclass
class Report:
    """Outcomes of targets; targets of equal outcome and output share an item."""

    items: dict[tuple[str, str | None], list[str]] = field(default_factory=dict)

    def add(self, outcome: str, output: str | None, *targets: str) -> "Report":
        self.items.setdefault((outcome, output), []).extend(targets)
        return self

    def success(self, *targets: str, output: str | None = None) -> "Report":
        return self.add(S.SUCCEEDED, output, *targets)

    def failed(self, output: str | None, *targets: str) -> "Report":
        return self.add(S.FAILED, output, *targets)

    @property
    def has_failures(self) -> bool:
        return any(o == S.FAILED for o, _ in self.items)

    def rows(self) -> list[dict]:
        return [{"outcome": o, "output": out, "targetIds": ids} for (o, out), ids in self.items.items()]


@dataclass
class Handler:
    run: Callable | None = None
    column: Callable[[DataFrame], Column] | None = None
    targets: Callable[[dict], list[str]] | None = None


class Registry:
    """Handlers by type key; the last one registered for a key counts."""

    def __init__(self):
        self.handlers: dict[str, Handler] = {}
        self.schedules: dict[str, TypeSchedule] = {}

    def add_handler(self, job_type: str | None, task_type: str | None, run: Callable | None = None, *, column=None, targets=None, batch_size: int | None = None, gap_seconds: float | None = None, max_attempts: int | None = None) -> str:
        """``run(job_payload, payload, context) -> Report | None``; or ``column(df) -> Column`` of report items."""
        if (run is None) == (column is None):
            raise ValueError("one of run and column is needed")
        key = f"{job_type or ''}|{task_type or ''}"
        self.handlers[key] = Handler(run, column, targets)
        self.schedules[key] = TypeSchedule(key, batch_size, gap_seconds, max_attempts)
        return key

    def execute(self, claimed: DataFrame, now: datetime) -> DataFrame:
        """(task_id, attempt, started_at, ended_at, report, failed) of claimed tasks with their context; times count from
        ``now``.

        Types with a column handler stay in the JVM; the others run in Arrow batches, where an error fails its attempt
        alone. A type without handler fails its attempts."""
        outs = []
        base = [F.col("id").alias("task_id"), "attempt", F.lit(now).alias("started_at"), F.lit(now).alias("ended_at")]
        fast = [k for k, h in self.handlers.items() if h.column is not None]
        slow = {k: h for k, h in self.handlers.items() if h.run is not None}
        for k in fast:
            rows = claimed.where(F.col("type_key") == k)
            outs.append(rows.select(*base, self.handlers[k].column(rows).cast(f"array<{S.ITEM}>").alias("report")))
        rest = claimed.where(~F.col("type_key").isin(*fast)) if fast else claimed
        out_schema = f"task_id string, attempt int, started_at timestamp, ended_at timestamp, report array<{S.ITEM}>"

        def run(frames):
            for pdf in frames:
                rows = []
                for t in pdf.itertuples(index=False):
                    began = time.perf_counter()
                    items = _attempt(slow.get(t.type_key), t)
                    rows.append((t.id, t.attempt, now, now + timedelta(seconds=time.perf_counter() - began), items))
                yield pd.DataFrame(rows, columns=["task_id", "attempt", "started_at", "ended_at", "report"])

        keep = ["id", "job_id", "type_key", "attempt", "max_attempts", "payload", "job_payload"]
        outs.append(rest.select(*keep).mapInPandas(run, out_schema))
        out = outs[0]
        for o in outs[1:]:
            out = out.unionByName(o)
        return out.withColumn("failed", reports.failed(F.col("report")))


def _attempt(handler: Handler | None, t) -> list[dict] | None:
    if handler is None:
        return [{"outcome": S.FAILED, "output": f"No handler registered for type key '{t.type_key}'", "targetIds": []}]
    targets: list[str] = []
    try:
        payload = json.loads(t.payload) if t.payload else None
        job = json.loads(t.job_payload) if t.job_payload else None
        targets = [str(x) for x in handler.targets(payload)] if handler.targets else []
        report = handler.run(job, payload, Context(t.job_id, t.id, t.type_key, int(t.attempt), int(t.max_attempts)))
    except Exception as e:  # a handler's error is the outcome of its attempt
        return [{"outcome": S.FAILED, "output": error_chain(e), "targetIds": targets}]
    items = report.rows() if report else []
    named = {x for i in items for x in i["targetIds"]}
    rest = [x for x in dict.fromkeys(targets) if x not in named]
    if rest:
        plain = next((i for i in items if i["outcome"] == S.SUCCEEDED and i["output"] is None), None)
        if plain:
            plain["targetIds"] = [*plain["targetIds"], *rest]
        else:
            items.append({"outcome": S.SUCCEEDED, "output": None, "targetIds": rest})
    return items or None
