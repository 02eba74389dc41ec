"""Queries on sources: scans, latest rows, cache, contests, reports, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.operators import contests, latest, skew
from kinprint.plans.registry import query
from kinprint.session import Workspace
from kinprint.sources.tables import table

NOW, GRACE_MINUTES, WINDOW_DAYS, PER_DOMAIN = "2025-07-01 00:00:00", 30, 730, 50


@query("""
with once as (
  select tid, pid, least(rid1, rid2) rid1, greatest(rid1, rid2) rid2, max(similarity) similarity
  from pairs where rid1 is not null and rid2 is not null and similarity is not null and rid1 <> rid2 group by all),
ranked as (
  select *, row_number() over (partition by tid, pid order by similarity, rid1, rid2) i, count(*) over (partition by tid, pid) n from once)
select tid, pid, rid1, rid2 from ranked where i = (n + 1) // 2""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The middle pair by similarity of every (tid, pid)."""
    return skew.middle_pairs(table(spark, folder, "pairs").select("tid", "pid", "rid1", "rid2", "similarity"), Workspace(spark, "p2"))


@query("""
select tid, pid, count(*) n_rows, count(similarity) n_scored, min(similarity) min_similarity,
  cast(sum(cast(similarity as decimal(20,8))) as double) / count(similarity) mean_similarity, max(similarity) max_similarity
from pairs group by tid, pid""")
def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Algebraic aggregates per (tid, pid)."""
    return skew.key_profile(table(spark, folder, "pairs").select("tid", "pid", "similarity"))


@query("select domain_id, tid, rid, uid, pid, lang from submissions")
def scan_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every submission with the scan's columns."""
    return table(spark, folder, "submissions").select("domain_id", "tid", "rid", "uid", "pid", "lang")


@query("select domain_id, tid, uid, pid, max(rid) rid from submissions group by all")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """The latest submission of every user and problem of a contest."""
    return latest.latest_submissions(table(spark, folder, "submissions")).select("domain_id", "tid", "uid", "pid", "rid")


@query("""
select rid, uid, case when files_code <> '' then split_part(files_code, '#', 1) end blob_id,
  case when files_code <> '' then '' else coalesce(code, '') end source from submissions""")
def fetch_code(spark: SparkSession, folder: str) -> DataFrame:
    """Source text: a named file wins over inline code (no blobs here, so it reads as empty)."""
    rows = latest.source_text(table(spark, folder, "submissions"))
    return rows.select("rid", "uid", latest.blob_id(F.col("files_code")).alias("blob_id"), "source")


@query("""
select domain_id, tid, rid, uid, pid from submissions s
where not exists (select 1 from (select distinct tid t, unnest(stats.trivial_pids) p from reports where stats is not null) x where x.t = s.tid and x.p = s.pid)""")
def exclude_pids(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions without the problems that some report of their contest lists as saturated."""
    out = table(spark, folder, "reports").select(F.col("tid").alias("t"), F.explode("stats.trivial_pids").alias("p")).distinct()
    rows = table(spark, folder, "submissions").select("domain_id", "tid", "rid", "uid", "pid")
    return rows.join(out, (F.col("tid") == F.col("t")) & (F.col("pid") == F.col("p")), "left_anti")


@query("""
select s.rid, f.rid is not null hit from (select distinct rid from submissions) s
left join (select distinct rid from features where k = 8 and schema_version = 3) f using (rid)""")
def cache_split(spark: SparkSession, folder: str) -> DataFrame:
    """Which submissions have a current features row."""
    return latest.cache_state(table(spark, folder, "submissions"), table(spark, folder, "features"))


@query("""
select 'contest' as scope, domain_id, tid, end_at from contests where rule is distinct from 'homework'
union all select 'homework', domain_id, tid, end_at from contests where rule = 'homework'
union all select 'both', domain_id, tid, end_at from contests""")
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Contests by scope."""
    rows = table(spark, folder, "contests").select("domain_id", "tid", "end_at", "rule")
    scopes = [contests.in_scope(rows, s).select(F.lit(s).alias("scope"), "domain_id", "tid", "end_at") for s in ("contest", "homework", "both")]
    return scopes[0].unionByName(scopes[1]).unionByName(scopes[2])


@query("""
select domain_id, tid, id, status, created_at from (
  select *, row_number() over (partition by domain_id, tid order by created_at desc, id desc) i from (select distinct domain_id, tid, id, status, created_at from reports)) where i = 1""")
def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """The newest report of every contest."""
    return contests.latest_reports(table(spark, folder, "reports").select("domain_id", "tid", "id", "status", "created_at"))


@query("""
with named as (select tid, unnest(pids) pid, nullif(trim(title), '') title from contests)
select p.tid, p.pid, coalesce(min(n.title), concat('P', p.pid)) label from (select distinct tid, pid from pairs) p left join named n using (tid, pid) group by p.tid, p.pid""")
def dim_label(spark: SparkSession, folder: str) -> DataFrame:
    """A label for every problem of the pairs: its contest's title, or P and the id."""
    named = table(spark, folder, "contests").select("tid", F.explode("pids").alias("pid"), F.nullif(F.trim("title"), F.lit("")).alias("title")).groupBy("tid", "pid").agg(F.min("title").alias("title"))
    keys = table(spark, folder, "pairs").select("tid", "pid").distinct()
    return keys.join(named, ["tid", "pid"], "left").select("tid", "pid", F.coalesce("title", F.concat(F.lit("P"), F.col("pid"))).alias("label"))


_ENDED = f"""select domain_id, tid, end_at from (
  select domain_id, tid, end_at, row_number() over (partition by domain_id order by end_at, tid) i from contests
  where end_at < timestamp '{NOW}' - interval {GRACE_MINUTES} minute and end_at > timestamp '{NOW}' - interval {WINDOW_DAYS} day) where i <= {PER_DOMAIN}"""


@query(_ENDED)
def ended_window(spark: SparkSession, folder: str) -> DataFrame:
    """Contests that ended within the window, at most 50 of a domain."""
    return contests.ended(table(spark, folder, "contests"), NOW, GRACE_MINUTES, WINDOW_DAYS, PER_DOMAIN).select("domain_id", "tid", "end_at")


@query(f"""
with last as (select * from (select *, row_number() over (partition by domain_id, tid order by created_at desc, id desc) i from reports) where i = 1)
select e.domain_id, e.tid from ({_ENDED}) e left join last using (domain_id, tid)
where last.id is null or (last.status = 'failed' and (last.finished_at is null or timestamp '{NOW}' - last.finished_at >= interval 1 hour))""")
def sweep_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Ended contests without a report, or whose newest report failed an hour ago or longer."""
    rows = contests.ended(table(spark, folder, "contests"), NOW, GRACE_MINUTES, WINDOW_DAYS, PER_DOMAIN)
    return contests.without_report(rows, table(spark, folder, "reports"), NOW).select("domain_id", "tid")


@query(f"""
select id, domain_id, tid, status, greatest(0, cast(floor(epoch(timestamp '{NOW}' - created_at) / 60) as bigint)) as minutes, coalesce(error, last_error) as error
from (select distinct id, domain_id, tid, status, created_at, error, last_error from reports where status in ('waiting', 'running', 'failed')) order by created_at, id limit 50""")
def queue(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 oldest unfinished or failed reports with their age in minutes."""
    return contests.queue(table(spark, folder, "reports"), NOW)


@query("""
with f as (select rid, bool_or(coalesce(k = 8 and schema_version = 3, false)) reusable from features group by rid),
newest as (select tid, max(rid) rid from submissions group by domain_id, tid, uid, pid),
cached as (select tid, count(*) docs, count_if(reusable) reusable from newest join f using (rid) group by tid)
select s.tid, count(*) total, count(distinct uid) users, count(distinct pid) problems, count(distinct coalesce(nullif(lang, ''), '?')) langs,
  count_if(coalesce(code, '') = '' and coalesce(files_code, '') = '') no_source, coalesce(max(docs), 0) cache_docs, coalesce(max(reusable), 0) cache_reusable
from submissions s left join cached using (tid) group by s.tid""")
def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Per contest: records, users, problems, languages, records without source, cached and reusable features."""
    return contests.diagnostics(table(spark, folder, "submissions"), table(spark, folder, "features"))


@query("""
select rid, case when source = '' then 'empty' when length(source) > 1200 then 'big' end reason
from (select rid, case when files_code <> '' then '' else coalesce(code, '') end source from submissions)""")
def skip_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a submission is not compared, at a size limit of 1200."""
    rows = latest.source_text(table(spark, folder, "submissions"))
    return rows.select("rid", latest.skip_reason(F.col("source"), max_code_size=1200).alias("reason"))


@query("select domain_id, tid, count(*) records, count(distinct uid) users from submissions group by all")
def contest_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Records and users of every contest."""
    return table(spark, folder, "submissions").groupBy("domain_id", "tid").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("uid").alias("users"))
