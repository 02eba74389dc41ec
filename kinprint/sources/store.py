"""Writers of pairs and features: replace, upsert and delete by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = ["domain_id", "tid"]


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(spark: SparkSession, column: str, value) -> str:
    """The partition folder that Spark's writer makes for a value: nulls and special characters have names of their own."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.getPartitionPathString(column, None if value is None or value == "" else str(value))


def drop_partition(spark: SparkSession, root: str, *key) -> bool:
    """Delete the rows of a table partitioned by PARTITION: of a contest (domain, tid) or of a whole domain.

    A null and an empty text have the same folder, as in Spark's writer.  False if there is nothing to delete.
    """
    target, fs = _hadoop(spark, "/".join([root, *(_folder(spark, c, v) for c, v in zip(PARTITION, key))]))
    return fs.delete(target, True) if fs.exists(target) else False


def drop_contest(spark: SparkSession, roots: list[str], domain_id, tid) -> list[bool]:
    """Delete a contest's rows from several tables (pairs, features, reports)."""
    return [drop_partition(spark, root, domain_id, tid) for root in roots]


def drop_domain(spark: SparkSession, roots: list[str], domain_id) -> list[bool]:
    """Delete a domain's rows from several tables."""
    return [drop_partition(spark, root, domain_id) for root in roots]


def replace_pairs(pairs: DataFrame, root: str, scanned: DataFrame) -> None:
    """Write the pairs of the scanned contests in place of what these had; a contest without pairs is emptied.

    scanned: domain_id, tid.  Writing again gives the same table.
    """
    spark = pairs.sparkSession
    rows = pairs.repartition(*PARTITION, F.pmod(F.xxhash64("rid1", "rid2"), F.lit(8)))
    rows.sortWithinPartitions("level", "similarity").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(root)
    kept = pairs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in PARTITION]).distinct()
    named = scanned.select(*PARTITION).distinct()
    empty = named.join(kept, [F.coalesce(named[c].cast("string"), F.lit("")) == kept[f"__{c}"] for c in PARTITION], "left_anti")
    for r in empty.toLocalIterator():  # one delete a contest without pairs: a metadata operation, no data passes
        drop_partition(spark, root, r["domain_id"], r["tid"])


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def upsert_features(current: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row a rid of old and new rows: the highest schema_version, of equal ones a new row; repeats are settled by all columns.

    Columns that only one side has are null on the other.  Rows without a rid are dropped.
    """
    fresh = new.where(F.col("rid").isNotNull()).withColumn("__new", F.lit(1))
    rows = fresh if current is None else fresh.unionByName(current.where(F.col("rid").isNotNull()).withColumn("__new", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__new"]
    # A map cannot be ordered, so rows are settled by their hash.
    plain = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.drop("__new").dtypes]
    rank = F.struct(F.coalesce("schema_version", F.lit(0)), F.col("__new"), F.xxhash64(*plain))
    return rows.groupBy("rid").agg(*[F.max_by(c, rank).alias(c) for c in columns if c != "rid"]).select(columns)
