"""Contests, their reports and what a scan would find: small control tables and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprint.operators import latest

KEY = ["domain_id", "tid"]


def in_scope(contests: DataFrame, scope: str = "both") -> DataFrame:
    """Contests that are homework, that are not (a null rule is not), or all."""
    homework = F.coalesce(F.col("rule") == "homework", F.lit(False))
    return contests.where(homework) if scope == "homework" else contests.where(~homework) if scope == "contest" else contests


def listed(contests: DataFrame, scope: str = "both") -> DataFrame:
    """The contests of a scope, the last to end first."""
    return in_scope(contests, scope).orderBy(F.desc("end_at"), F.desc("begin_at"), F.desc("tid"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of every contest by created_at, then id."""
    return latest.latest_per_key(reports, KEY, ["created_at", "id"])


def _time(now: str):
    return F.lit(now).cast("timestamp_ntz")


def ended(contests: DataFrame, now: str, grace_minutes: int = 30, window_days: int = 30, per_domain: int = 50) -> DataFrame:
    """Contests that ended before now less the grace and after the window's start, the first of each domain.

    Both bounds are exclusive; a null end is never within them.
    """
    since, until = _time(now) - F.expr(f"interval {window_days} days"), _time(now) - F.expr(f"interval {grace_minutes} minutes")
    first = Window.partitionBy("domain_id").orderBy("end_at", "tid")
    return contests.where((F.col("end_at") < until) & (F.col("end_at") > since)).withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= per_domain).drop("__i")


def without_report(contests: DataFrame, reports: DataFrame, now: str) -> DataFrame:
    """Contests that have no report, or whose newest one failed an hour ago or longer (or at an unknown time)."""
    last = latest_reports(reports.select(*KEY, "created_at", "id", "status", "finished_at"))
    old = F.coalesce(_time(now) - F.col("finished_at") >= F.expr("interval 1 hour"), F.lit(True))
    joined = contests.join(last.select(*KEY, F.col("id").alias("__id"), F.col("status").alias("__status"), old.alias("__old")), KEY, "left")
    return joined.where(F.col("__id").isNull() | ((F.col("__status") == "failed") & F.col("__old"))).drop("__id", "__status", "__old")


def queue(reports: DataFrame, now: str, most: int = 50) -> DataFrame:
    """The oldest reports that wait, run or failed, each once, with their age in whole minutes."""
    open_ = reports.where(F.col("status").isin("waiting", "running", "failed")).select("id", *KEY, "status", "created_at", "error", "last_error").distinct()
    age = F.floor(F.timestamp_diff("SECOND", F.col("created_at"), _time(now)) / 60)
    return open_.orderBy("created_at", "id").limit(most).select("id", *KEY, "status", F.greatest(F.lit(0), age).cast("bigint").alias("minutes"), F.coalesce("error", "last_error").alias("error"))


def diagnostics(submissions: DataFrame, features: DataFrame, k: int = 8, schema_version: int = 3) -> DataFrame:
    """Per contest: records, users, problems, languages, records without source, and cached features of the latest submissions."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    counts = submissions.groupBy("tid").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("uid").alias("users"), F.count_distinct("pid").alias("problems"),
        F.count_distinct(F.coalesce(F.nullif("lang", F.lit("")), F.lit("?"))).alias("langs"), F.count_if(blank("code") & blank("files_code")).alias("no_source"),
    )
    current = F.coalesce((F.col("k") == k) & (F.col("schema_version") == schema_version), F.lit(False))
    cached = features.groupBy("rid").agg(F.bool_or(current).alias("reusable"))
    newest = latest.latest_submissions(submissions.select("domain_id", "tid", "uid", "pid", "rid")).select("tid", "rid")
    use = newest.join(cached, "rid").groupBy("tid").agg(F.count(F.lit(1)).alias("cache_docs"), F.count_if("reusable").alias("cache_reusable"))
    return counts.join(use, "tid", "left").fillna(0, ["cache_docs", "cache_reusable"])
