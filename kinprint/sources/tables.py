"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: k and schema_version of a features row that counts.
K, SCHEMA_VERSION = 8, 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; only the columns a plan uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settings_rows(df: DataFrame, most: int, name: str) -> list[Row]:
    """All rows of a settings table; one of more than `most` rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} is a settings table of at most {most} rows")
    return rows


def counted_features(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The rows of the current fingerprint version with the given columns.

    A rid may still stand twice; its rows agree, and callers take each rid once.
    """
    rows = table(spark, folder, "features").where((F.col("k") == K) & (F.col("schema_version") == SCHEMA_VERSION) & F.col("rid").isNotNull())
    return rows.select("rid", *columns)
