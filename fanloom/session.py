"""Session helpers: a local session for tests and benches, worker import path, and the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local(cores: str = "8", **conf: str) -> SparkSession:
    """A local session as tests and benches use it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset and the master is local (tests), an own
    temporary one, which goes when the process ends; on a cluster it must be set, as executors share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fanloom-")
        atexit.register(shutil.rmtree, own, True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_written: dict[str, object] = {}


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's process ends."""
    if not _written:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/fanloom/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    return path


def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            _written.pop(path, None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that lost executors don't cost the steps before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that don't clash with the ones taken (compared without case)."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out
