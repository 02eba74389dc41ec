"""Session defaults, and tables written between the steps of an iterative job.

Iterative operators cut their lineage by writing a table into the shared
checkpoint folder and reading it back.  Such a table survives the loss of any
executor, is computed once, and keeps its columns and statistics.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

atexit.register(lambda: release())

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "kinprint", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; conf keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir).

    Only a local session without that setting gets a folder of its own, since
    there driver and executors share one disk; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kinprint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer than two partitions a core, dealt over all cores for costly work in Python.

    A table of many files is left as it is.  Only for plans without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


_OPEN: list[Workspace] = []


def release() -> None:
    """Remove the tables of all jobs so far; call it once their results have been read."""
    while _OPEN:
        _OPEN.pop().close()


class Workspace:
    """Tables of one job below the checkpoint folder.

    drop() removes one early, close() (or leaving a with block) all of them.  As a
    result is read from its job's tables, a job that returns a DataFrame leaves closing to its
    caller: release() closes what is still open, at the end of the session at the latest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinprint-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
        _OPEN.append(self)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove all tables of this job."""
        if self in _OPEN:
            _OPEN.remove(self)
        self._remove(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df once and read it back with the same columns and types."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[back] = path
        return back

    def write_counted(self, df: DataFrame, test: Column) -> tuple[DataFrame, int]:
        """Write df and count the rows that pass a test on the way."""
        seen = Observation()
        back = self.write(df.observe(seen, F.count_if(test).alias("n")))
        return back, seen.get.get("n") or 0

    def drop(self, table: DataFrame | None) -> None:
        """Remove a table that no later step reads."""
        path = self._paths.pop(table, None) if table is not None else None
        if path:
            self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing is left to ask
            pass
