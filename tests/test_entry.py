import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinprint.streaming import events
from tests.conftest import rows

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "kinprint").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "kinprint").parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry_module_without_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "kinprint", tmp_path / "kinprint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'scan_pairs' in e.queries() and 'p1_found' not in e.queries()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-01 00:50:00", 1, "a", 2.0), (3, "2024-01-01 02:00:00", 1, "b", 4.0), (4, None, 2, "b", 4.0)], "event_id bigint, ts string, user_id bigint, event_type string, value double")
    data.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    schema = spark.read.parquet(folder + "/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).parquet(folder + "/events.parquet")
    counts = rows(events.run_to_end(spark, events.tumbling_counts(stream()), "update", "t1"))
    assert [(c[1], c[2], c[3]) for c in counts] == [("a", 2, 3.0), ("b", 1, 4.0)]
    out = str(tmp_path / "latest")
    events.merge_latest(spark, stream(), out, str(tmp_path / "cp"), 4).awaitTermination()
    assert rows(spark.read.parquet(out).select("user_id", "event_type", "event_id")) == [(1, "a", 2), (1, "b", 3), (2, "b", 4)]


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_queries_read_files_and_folders(spark, tmp_path, files):
    import __spark_entry__ as e

    def put(df, name):  # 0: the table is a file
        df.repartition(files or 1).write.parquet(str(tmp_path / "made" / name))
        parts = [str(p) for p in (tmp_path / "made" / name).glob("*.parquet")]
        os.rename(str(tmp_path / "made" / name) if files else parts[0], tmp_path / f"{name}.parquet")

    (tmp_path / "made").mkdir()
    texts = [(n, "d", "c", "int a;", None) for n in range(6)] + [(9, "d", "c", None, None)]
    put(spark.createDataFrame(texts, "rid bigint, domain_id string, lang string, code string, files_code string"), "submissions")
    seen = [(n, f"2024-01-01 00:1{n}:00", n % 2, "a", 1.0) for n in range(6)]
    put(spark.createDataFrame(seen, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "events")
    run = lambda name: e.queries()[name](spark, str(tmp_path))
    assert rows(run("stream_features").select("rid", "token_count")) == [(n, 3) for n in range(6)]
    assert rows(run("stream_tumbling").select("n", "total")) == [(6, 6.0)]
    assert rows(run("stream_latest").select("user_id", "event_id")) == [(0, 4), (1, 5)]


def test_latest_events_over_batches(spark, tmp_path):
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "2024-01-02", 1, "a", 1.0), (2, "2024-01-03", 2, "a", None)], [(3, "2024-01-01", 1, "a", 5.0), (4, "2024-01-05", None, "a", 5.0)], [(5, "2024-01-04", 2, "a", 2.0), (6, None, 3, "b", 1.0)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(src)
        events.merge_latest(spark, spark.readStream.schema(ddl).parquet(src), out, str(tmp_path / "cp"), 2).awaitTermination()
    assert rows(spark.read.parquet(out).select("user_id", "event_type", "event_id")) == sorted([(1, "a", 1), (2, "a", 5), (3, "b", 6), (None, "a", 4)], key=repr)


def test_incremental_features(spark, tmp_path):
    ddl = "rid bigint, domain_id string, lang string, code string, files_code string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    blobs = spark.createDataFrame([("b1", bytearray(b"int a, b;"))], "id string, content binary")
    first = [(1, "d", "c", "int a;", None), (1, "d", "c", "int a;", None), (5, "d", "c", "int a;", "gone#x")]
    for batch in (first, [(1, "d", "c", "int a;", None), (2, "d", None, None, None), (3, "d", "c", "int z;", "b1#main"), (4, "d", "c", "x", "")]):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        events.incremental_features(spark, spark.readStream.schema(ddl).parquet(src), out, str(tmp_path / "cp"), blobs=blobs).awaitTermination()
    assert rows(spark.read.parquet(out).select("rid", "token_count")) == [(1, 3), (3, 5), (4, 1)]


def test_stale_features_are_made_anew(spark, tmp_path):
    from kinprint.functions.artifacts import with_artifacts

    ddl = "rid bigint, domain_id string, lang string, code string, files_code string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    made = with_artifacts(spark.createDataFrame([(1, "d", "c", "int a;"), (2, "d", "c", "int a;")], "rid bigint, domain_id string, lang string, code string"))
    made.withColumn("schema_version", F.when(F.col("rid") == 1, 2).otherwise(3)).write.parquet(out)
    spark.createDataFrame([(1, "d", "c", "int a, b;", None), (2, "d", "c", "int a, b;", None)], ddl).write.parquet(src)
    events.incremental_features(spark, spark.readStream.schema(ddl).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select("rid", "schema_version", "token_count")) == [(1, 2, 3), (1, 3, 5), (2, 3, 3)]
