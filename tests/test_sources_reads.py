"""Sources, report resolution, CSV files and read rules on small rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fanloom.functions import reports
from fanloom.operators import fanout, recover
from fanloom.plans import reads
from fanloom.sources import adapters

ITEM = "array<struct<outcome:string,output:string,targetIds:array<string>>>"


def test_sources(spark, tmp_path):
    df = adapters.rows(spark, [{"a": 1}, {"a": 2}], "a int")
    assert [(r.a, r.ord) for r in df.collect()] == [(1, 0), (2, 1)]
    df.write.json(f"{tmp_path}/j")
    assert adapters.documents(spark, f"{tmp_path}/j", "json", "a int, ord bigint").count() == 2
    assert adapters.sql(spark, "select :x + 1 as y", x=2).first().y == 3
    assert adapters.table_rows(df, "a", 2).count() == 1
    assert [(r.start_index, r["count"]) for r in adapters.seed_ranges(spark, 2500, 1000).collect()] == [(0, 1000), (1000, 1000), (2000, 500)]
    e = adapters.entities(spark, 3, size_kb=10).collect()
    assert len(e[0].filings) == 6 and e[0].taxCode == "TAX-1K" and len({x.id for x in e}) == 3
    assert adapters.activity(spark, 30).count() == 30


def test_fanout_keeps_nulls_and_rejects_blank_sql(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert fanout.one_to_one(df, None).first().payload == '{"a":1,"b":null}'
    assert fanout.raw_sql(spark, "select '{}' ;").columns == ["payload"]
    for bad in ("  ", " ; "):
        with pytest.raises(ValueError):
            fanout.raw_sql(spark, bad)
    with pytest.raises(ValueError):
        fanout.raw_sql(spark, "select 1, 2")
    with pytest.raises(ValueError):
        fanout.batched(df, None, F.col("a"), "ids", 0, "a")


def test_batches_of_seven(spark):
    got = fanout.batched(spark.range(7), None, F.col("id"), "Ids", 3, "id").orderBy("batch").collect()
    assert [r.payload for r in got] == ['{"Ids":[0,1,2]}', '{"Ids":[3,4,5]}', '{"Ids":[6]}']


def test_resolution(spark):
    rows = [
        ([("Succeeded", None, ["a"])], ["a", "b"]),
        ([("Failed", "x", ["a"])], ["a", "b"]),
        (None, ["a"]),
        (None, []),
        ([("Failed", None, [])], []),
    ]
    df = spark.createDataFrame(rows, f"items {ITEM}, targets array<string>")
    got = [r[0] and [tuple(i) for i in r[0]] for r in df.select(reports.resolve(F.col("items"), F.col("targets"))).collect()]
    assert got == [[("Succeeded", None, ["a", "b"])], [("Failed", "x", ["a"]), ("Succeeded", None, ["b"])], [("Succeeded", None, ["a"])], None, [("Failed", None, [])]]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("Failed", 'say "no", twice', ["1", "2"]), ("Succeeded", None, [])], "outcome string, output string, targetIds array<string>")
    reports.write_csv(df.coalesce(1), f"{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").collect()
    assert [tuple(r) for r in back][0] == ("Failed", 'say "no", twice', "2", "1;2")


def test_reads(spark):
    jobs = spark.createDataFrame([(str(k), "n", "t", "Active", datetime(2024, 1, 1, 0, 0, k % 60)) for k in range(70)], "id string, name string, type string, status string, created_at timestamp")
    assert reads.jobs_list(jobs, 0).count() == 1 and reads.jobs_list(jobs, 10_000).count() == 70 and reads.jobs_list(jobs).count() == 50
    kind, rows = reads.drill(jobs, "hour", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert kind == "buckets" and rows.count() == 1
    kind, rows = reads.drill(jobs.limit(5), "hour", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert kind == "items" and rows.count() == 5
    with pytest.raises(ValueError):
        reads.histogram(jobs, "week")


def test_busy_instances_stay(spark):
    beats = spark.createDataFrame([("a", datetime(2024, 1, 1), 1)], "instance_id string, last_seen_at timestamp, executing int")
    tasks = spark.createDataFrame([("1", "Running", "a")], "id string, state string, claimed_by string")
    assert recover.remove_instance(beats, tasks, "a").count() == 1
    assert recover.remove_instance(beats, tasks.limit(0), "a").count() == 0


def test_the_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from fanloom import session

    def at(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            session.shared_dir(at(master))
        assert session.shared_dir(at(master, "hdfs:///tmp/x/")) == "hdfs:///tmp/x"


def test_entry_stands_a_leftover_folder_of_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "fanloom", tmp_path / "fanloom", ignore=ignore)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    (tmp_path / "fanloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[2] == "False", said.stderr
