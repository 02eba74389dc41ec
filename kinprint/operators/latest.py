"""Latest row per key, cached features, and readers of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`, then by all other columns.

    A combining aggregate: each task keeps one row a key before the shuffle, so hot
    keys cost nothing extra.  Null keys form groups; nulls in order come first.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    top = df.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("__top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"__top.{c}").alias(c) for c in df.columns])


def latest_submissions(submissions: DataFrame) -> DataFrame:
    """The newest submission (greatest rid) of every user to every problem of a contest; repeated rows count once."""
    return latest_per_key(submissions, ["domain_id", "tid", "uid", "pid"], ["rid"])


def blob_id(files_code: Column) -> Column:
    """The part of a file reference before '#', null where there is no reference."""
    return F.when(F.length(files_code) > 0, F.split_part(files_code, F.lit("#"), F.lit(1)))


def source_text(submissions: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """submissions with source: the blob's text where a file is named, else the inline code; never null.

    A named blob that is missing or unreadable gives an empty text and does not fall
    back to the inline code.  blobs: id, content (binary).
    """
    inline = F.coalesce("code", F.lit(""))
    if blobs is None:
        return submissions.withColumn("source", F.when(F.length("files_code") > 0, F.lit("")).otherwise(inline))
    texts = blobs.where(F.col("id").isNotNull() & (F.length("content") <= 64 * 1024 * 1024)).groupBy("id").agg(F.max("content").alias("__content"))
    joined = submissions.withColumn("__blob", blob_id(F.col("files_code"))).join(texts.withColumnRenamed("id", "__id"), F.col("__blob") == F.col("__id"), "left")
    text = F.col("__content").cast("string")
    return joined.withColumn("source", F.when(F.col("__blob").isNotNull(), F.coalesce(text, F.lit(""))).otherwise(inline)).drop("__blob", "__id", "__content")


def code_units(text: Column) -> Column:
    """Length of a text in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")


def skip_reason(source: Column, token_count: Column | None = None, max_code_size: int = 1_048_576, min_tokens: int = 0) -> Column:
    """empty, big, short or null for a text that is scanned."""
    out = F.when(source == "", "empty").when(code_units(source) > max_code_size, "big")
    return out if token_count is None else out.when(token_count < min_tokens, "short")


def usable(features: DataFrame, k: int = 8, schema_version: int = 3) -> DataFrame:
    """One features row a rid among those of the current k and schema version."""
    return features.where((F.col("k") == k) & (F.col("schema_version") == schema_version) & F.col("rid").isNotNull()).dropDuplicates(["rid"])


def cache_state(submissions: DataFrame, features: DataFrame, k: int = 8, schema_version: int = 3, ignore_cache: bool = False) -> DataFrame:
    """rid and hit for every submission: whether a current features row exists."""
    rids = submissions.select("rid").distinct()
    if ignore_cache:
        return rids.withColumn("hit", F.lit(False))
    hits = features.where((F.col("k") == k) & (F.col("schema_version") == schema_version)).select(F.col("rid").alias("r")).distinct()
    return rids.join(hits, rids["rid"] == hits["r"], "left").select("rid", F.col("r").isNotNull().alias("hit"))
