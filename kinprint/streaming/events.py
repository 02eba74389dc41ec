"""Streaming counterparts: tumbling counts, latest rows and incremental features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions.artifacts import with_artifacts
from kinprint.operators.latest import latest_per_key, source_text, usable
from kinprint.session import Workspace


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Events and their values' sum per window and type; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).where(F.col("at").isNotNull())
    return timed.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def latest_events(events: DataFrame) -> DataFrame:
    """The latest event of every user and type in a batch, by ts and event_id; nulls come first."""
    return events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.ts", "m.event_id", "m.value")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there (Trigger.AvailableNow) and give its final table.

    In 'append' mode every batch adds its rows; in 'update' mode a batch holds new values
    of some keys of tumbling_counts, and the last one of each key counts.
    """
    work = Workspace(spark, name)
    out = f"{work.root}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work.root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("__batch", "integer")).parquet(out) if _exists(spark, out) else spark.createDataFrame([], stream.schema.add("__batch", "integer"))
    if mode == "update":
        rows = latest_per_key(rows, ["start", "event_type"], ["__batch"])
    return rows.drop("__batch")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


#: Folders by user that the latest events lie in; a batch rewrites those it has users of.
PARTS = 64


def merge_latest(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, parts: int = PARTS):
    """Keep the latest event of every user and type in the table target, as a stream without state.

    A batch is reduced to one row a key, which is merged by key into the parts of the table that
    its users fall into; other parts are not read or written.  A part is replaced as a whole, so a replayed batch changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        part = F.pmod(F.hash("user_id"), F.lit(parts)).alias("part")
        fresh = latest_events(batch).select("*", part)
        rows = fresh
        if _exists(spark, target):
            touched = fresh.select("part").distinct()
            rows = fresh.unionByName(spark.read.schema(fresh.schema).parquet(target).join(F.broadcast(touched), "part", "left_semi"))  # at most `parts` rows
        with Workspace(spark, "latest") as work:
            merged = work.write(latest_per_key(rows, ["part", "user_id", "event_type"], ["ts", "event_id", "value"]))
            merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def read_events(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    path = f"{folder}/{table}.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema)
    if _is_folder(spark, path):
        return files.parquet(path)
    return files.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def incremental_features(spark: SparkSession, submissions: DataFrame, target: str, checkpoint: str, k: int = 8, blobs: DataFrame | None = None):
    """Append the features of submissions that have no current ones, batch by batch; a replayed batch adds nothing.

    Current are rows of this k and schema version, so stale rows are made anew (and readers take the current
    ones, see latest.usable).  The text is the named file's, or the inline code where none is named (latest.source_text);
    without text there is nothing to lex and no row.
    """

    def put(batch: DataFrame, _: int) -> None:
        fresh = latest_per_key(batch.where(F.col("rid").isNotNull()).select("rid", "domain_id", "lang", "code", "files_code"), ["rid"], ["domain_id"])
        if _exists(spark, target):
            fresh = fresh.join(usable(spark.read.parquet(target), k).select("rid"), "rid", "left_anti")
        texts = source_text(fresh, blobs).where(F.col("source") != "").select("rid", "domain_id", "lang", "source")
        with_artifacts(texts, "source", "lang", k).write.mode("append").parquet(target)

    return submissions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
