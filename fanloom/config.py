"""Validated configuration: schedules of task types, engine options, retention."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom import schema as S

PAUSE_STATES = ("active", "paused", "resuming_rebase", "resuming_asis")


@dataclass(frozen=True)
class TypeSchedule:
    """How a task type is spread: ``batch_size`` tasks a slot, ``gap_seconds`` between slots. None inherits."""

    type_key: str
    batch_size: int | None = None
    gap_seconds: float | None = None
    max_attempts: int | None = None
    pause_state: str = "active"

    def __post_init__(self):
        if not self.type_key or not self.type_key.strip():
            raise ValueError("a type key is needed")
        if self.batch_size is not None and self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.gap_seconds is not None and not (math.isfinite(self.gap_seconds) and self.gap_seconds > 0):
            raise ValueError("gap_seconds must be finite and over 0")
        if self.max_attempts is not None and self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")
        if self.pause_state not in PAUSE_STATES:
            raise ValueError(f"pause_state must be one of {PAUSE_STATES}")
        if self.type_key == S.DEFAULT_KEY and None in (self.batch_size, self.gap_seconds, self.max_attempts):
            raise ValueError("the default row must be complete")

    def row(self) -> tuple:
        return self.type_key, self.batch_size, self.gap_seconds, self.max_attempts, self.pause_state


DEFAULT_SCHEDULE = TypeSchedule(S.DEFAULT_KEY, S.DEFAULT_BATCH, S.DEFAULT_GAP, S.DEFAULT_ATTEMPTS)


def schedules(spark: SparkSession, *rows: TypeSchedule) -> DataFrame:
    """A schedule table of the rows, with the default row where none is given."""
    if not any(r.type_key == S.DEFAULT_KEY for r in rows):
        rows = (DEFAULT_SCHEDULE, *rows)
    return spark.createDataFrame([r.row() for r in rows], S.SCHEDULE)


def violations() -> Column:
    """Names of the rules that a row of a schedule table breaks: those of ``TypeSchedule``, for whole tables."""
    default = F.col("type_key") == S.DEFAULT_KEY
    gap = F.col("gap_seconds")
    rules = {
        "type_key": F.coalesce(F.trim("type_key"), F.lit("")) == "",
        "batch_size": F.col("batch_size") < 1,
        "gap_seconds": F.isnan(gap) | (gap <= 0) | (gap == float("inf")),
        "max_attempts": F.col("max_attempts") < 1,
        "pause_state": ~F.coalesce(F.col("pause_state").isin(*PAUSE_STATES), F.lit(False)),
        "default": default & (F.col("batch_size").isNull() | gap.isNull() | F.col("max_attempts").isNull()),
    }
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items()]), lambda x: x.isNotNull())


@dataclass(frozen=True)
class EngineOptions:
    """What of a worker's settings has a meaning here; times are in seconds."""

    instance_id: str = "local"
    claim_batch: int = 128
    stale_after: float = 15.0
    self_grace: float = 30.0
    backoff_base: float = 2.0
    backoff_max: float = 300.0
    heartbeat_every: float = 3.0
    refresh_every: float = 2.0
    compact_every: float = 5.0
    compact_jobs: int = 50
    chunk_targets: int = 10_000
    purge_limit: int = 1000
    recover_every: float = 10.0
    purge_every: float = 60.0
    reconcile_every: float = 2.0
    reconcile_chunk: int = 10_000
    reconcile_pass: int = 200_000

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "instance_id" and not v > 0:
                raise ValueError(f"{f.name} must be over 0")
        if not self.instance_id.strip():
            raise ValueError("instance_id is empty")
        if self.backoff_max < self.backoff_base:
            raise ValueError("backoff_max must not be under backoff_base")
        if self.stale_after <= self.heartbeat_every:
            raise ValueError("stale_after must be over heartbeat_every")


@dataclass(frozen=True)
class Retention:
    """How long finished jobs stay, by job type; None keeps them for ever."""

    default: timedelta | None = None
    by_type: dict[str, timedelta | None] = field(default_factory=dict)

    def __post_init__(self):
        for v in (self.default, *self.by_type.values()):
            if v is not None and v <= timedelta(0):
                raise ValueError("a retention must be over 0")

    def column(self, job_type: Column) -> Column:
        """Seconds to keep jobs of a type, null for ever."""
        out = F.lit(None if self.default is None else self.default.total_seconds()).cast("double")
        for name, keep in self.by_type.items():
            out = F.when(job_type == name, F.lit(None if keep is None else keep.total_seconds()).cast("double")).otherwise(out)
        return out
