"""The whole scan and the streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions.artifacts import with_artifacts
from kinprint.operators import latest
from kinprint.plans import queries_groups as groups
from kinprint.plans import scan
from kinprint.plans import sql_lexer as sql
from kinprint.plans.registry import query
from kinprint.session import Workspace
from kinprint.sources import store
from kinprint.sources.tables import table
from kinprint.streaming import events

#: Problems that scan_without leaves out.
EXCLUDED = (1014, 1055)


@query()
def scan_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The full scan of all contests: classified pairs with all evidence."""
    return scan.scan(table(spark, folder, "submissions"), table(spark, folder, "features"), Workspace(spark, "scan"))[0]


# The scan in SQL, from the sources to the levels; sequences and functions, which SQL has no plain form for, are left to seq_sim, code_functions and func_sim.
_DICE = "case when len({0}) > 0 and len({1}) > 0 then 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) end"
_COSINE = "case when len(x) > 0 and len(y) > 0 and list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(y, lambda v: v * v)) > 0 then list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(y, lambda v: v * v))) end"
_SCOPE = "domain_id, tid, pid"
_SCAN = f"""{groups.MEDIAN},
state as (select {_SCOPE}, median >= 0.8 and n_pairs >= 10 trivial from medians),
gw as (select g.domain_id, g.tid, g.pid, g.rep, e.key k, e.value * ln(1 + s.g::double / f.df) w
  from (select *, unnest(map_entries(tf)) e from groups) g join (select {_SCOPE}, k, count(*) df from (select {_SCOPE}, unnest(map_keys(tf)) k from groups) group by all) f on f.domain_id = g.domain_id and f.tid = g.tid and f.pid = g.pid and f.k = e.key
  join (select {_SCOPE}, count(*) g from groups group by all) s on s.domain_id = g.domain_id and s.tid = g.tid and s.pid = g.pid where e.value is not null),
norms as (select {_SCOPE}, rep, sum(w * w) q from gw group by all),
crossing as (select {_SCOPE}, rep1, rep2, sim, common from found where sim >= 0.55),
dots as (select c.domain_id, c.tid, c.pid, rep1, rep2, sum(a.w * b.w) d from crossing c join gw a on a.domain_id = c.domain_id and a.tid = c.tid and a.pid = c.pid and a.rep = rep1
  join gw b on b.domain_id = c.domain_id and b.tid = c.tid and b.pid = c.pid and b.rep = rep2 and b.k = a.k group by all),
evident as (select c.*, case when a.q * b.q > 0 then coalesce(d, 0) / sqrt(a.q * b.q) end sim_tfidf, (select {_COSINE} from (select x.struct_vec x, y.struct_vec y)) sim_struct
  from crossing c join groups x on x.domain_id = c.domain_id and x.tid = c.tid and x.pid = c.pid and x.rep = rep1 join groups y on y.domain_id = c.domain_id and y.tid = c.tid and y.pid = c.pid and y.rep = rep2
  left join norms a on a.domain_id = c.domain_id and a.tid = c.tid and a.pid = c.pid and a.rep = rep1 left join norms b on b.domain_id = c.domain_id and b.tid = c.tid and b.pid = c.pid and b.rep = rep2
  left join dots o on o.domain_id = c.domain_id and o.tid = c.tid and o.pid = c.pid and o.rep1 = c.rep1 and o.rep2 = c.rep2
  union all select {_SCOPE}, rep, rep, 1.0, token_count, 1.0, 1.0 from groups),
langs as (select rid, any_value(lang) lang from submissions group by rid),
own as (select d.*, g.rep, n.lang from docs d join groups g using (domain_id, tid, pid, code_hash) left join langs n using (rid)),
wide as (select e.domain_id, e.tid, e.pid, sim, common, sim_tfidf, sim_struct, least(a.uid, b.uid) uid1, greatest(a.uid, b.uid) uid2, case when a.uid < b.uid then a else b end p, case when a.uid < b.uid then b else a end q
  from evident e join own a on a.domain_id = e.domain_id and a.tid = e.tid and a.pid = e.pid and a.rep = rep1 join own b on b.domain_id = e.domain_id and b.tid = e.tid and b.pid = e.pid and b.rep = rep2
  where a.uid <> b.uid and (rep1 <> rep2 or a.uid < b.uid)),
named as (select *, {_DICE.format("p.lex_hashes", "q.lex_hashes")} lex, (select {_DICE.format("x", "y")} from (select {groups._NAMES.format("p.idents")} x, {groups._NAMES.format("q.idents")} y)) var from wide),
levels as (select n.*, case when coalesce(trivial, false)
  then case when coalesce(lex, sim) >= 0.95 and coalesce(var >= 0.8, true) then 3 when coalesce(lex, sim) >= 0.75 then 2 when coalesce(lex, sim) >= 0.55 then 1 else 0 end
  else case when sim >= 0.95 then case when coalesce(lex >= 0.85, false) or coalesce(var >= 0.6, false) then 3 else 2 end when sim >= 0.75 then 2 when sim >= 0.55 then 1 else 0 end end level
  from named n left join state using (domain_id, tid, pid)),
pairs_ as (select {_SCOPE}, uid1, uid2, p.rid rid1, q.rid rid2, p.lang lang1, q.lang lang2, {groups.R4.format('sim')} similarity, level, common::int common, {groups.R4.format('lex')} sim_lex, {groups.R4.format('sim_tfidf')} sim_tfidf, {groups.R4.format('var')} sim_var, {groups.R4.format('sim_struct')} sim_struct,
  len(list_intersect(coalesce(p.comment_hashes, []), coalesce(q.comment_hashes, []))) shared_comments, array_to_string(p.flags, ',') flags1, array_to_string(q.flags, ',') flags2 from levels where level >= 1)"""


@query(f"with {_SCAN} select * from pairs_")
def scan_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The full scan's pairs with all that SQL can answer."""
    rows = scan_pairs(spark, folder).drop("sim_seq", "sim_func")
    return rows.withColumns({c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in ("flags1", "flags2")})


@query(f"""with {sql.FEATURES},
rows_ as (select rid, any_value(case when files_code <> '' then '' else coalesce(code, '') end) source from submissions where rid is not null group by rid)
select rid, coalesce(hit, false) hit, case when coalesce(hit, false) then null when source = '' then 'empty' when length(source) > 1200 then 'big' when coalesce(token_count, 0) < 60 then 'short' end reason from rows_ left join feats using (rid)""")
def scan_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every submission as a scan of all attempts takes it: from the cache, computed or skipped (above 1200 units, below 60 tokens)."""
    config = scan.ScanConfig(mode="all", max_code_size=1200, min_tokens=60)
    return scan.featured(scan.collect(table(spark, folder, "submissions"), config), table(spark, folder, "features"), config).select("rid", "hit", "reason")


@query(f"with s as (select domain_id, tid, pid, uid, max(rid) rid from submissions where rid is not null group by all) select domain_id, tid, pid, uid, rid from s where pid is null or pid not in ({', '.join(map(str, EXCLUDED))})")
def scan_without(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan collects when two problems are excluded."""
    config = scan.ScanConfig(exclude_pids=EXCLUDED)
    return scan.collect(table(spark, folder, "submissions"), config).select("domain_id", "tid", "pid", "uid", "rid")


@query(f"""with {_SCAN},
every as (select {_SCOPE}, uid, max(rid) rid from submissions where rid is not null group by all),
texts_ as (select rid, any_value(case when files_code <> '' then '' else coalesce(code, '') end) source from submissions where rid is not null group by rid),
seen_ as (select domain_id, tid, count(distinct uid) filter (hit is not null) users, count_if(hit is not null) submissions, count_if(hit is null) skipped, 0 skipped_short, 0 skipped_big, count_if(hit is null) skipped_empty, count_if(coalesce(hit, false)) cache_hits
  from every e join texts_ using (rid) left join feats using (rid) group by all),
got as (select domain_id, tid, count(*) pairs, count_if(level = 1) l1, count_if(level = 2) l2, count_if(level = 3) l3 from pairs_ group by all),
flat_ as (select domain_id, tid, array_to_string(list_sort(list(distinct pid)), ',') t from state where trivial group by all)
select s.*, coalesce(pairs, 0) pairs, coalesce(l1, 0) l1, coalesce(l2, 0) l2, coalesce(l3, 0) l3, coalesce(t, '') trivial_pids from seen_ s left join got using (domain_id, tid) left join flat_ using (domain_id, tid)""")
def report_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the full scan, per contest."""
    work = Workspace(spark, "stats")
    pairs, docs, state = scan.scan(table(spark, folder, "submissions"), table(spark, folder, "features"), work)
    out = scan.report_stats(docs, work.write(pairs), state)
    return out.withColumn("trivial_pids", F.array_join(F.col("trivial_pids").cast("array<string>"), ","))


@query("""
select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, cast(sum(cast(value as decimal(18,4))) as double) total from events where ts is not null group by all""")
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of events by type, as a stream in update mode: windows two days behind the newest event leave the state."""
    return events.run_to_end(spark, events.tumbling_counts(events.read_events(spark, folder)), "update", "tumbling")


@query("""
select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc, value desc) i from events) where i = 1""")
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of every user and type, merged by key from a stream."""
    work = Workspace(spark, "latest")
    events.merge_latest(spark, events.read_events(spark, folder), f"{work.root}/out", f"{work.root}/state").awaitTermination()
    return spark.read.parquet(f"{work.root}/out").drop("part")


@query(f"with {sql.TEXTS}, {sql.HASHED} select rid, code_hash, len(t) token_count, 3 as schema_version from made")
def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of all submissions, made incrementally from a stream of them."""
    work = Workspace(spark, "features")
    out = f"{work.root}/out"
    events.incremental_features(spark, events.read_events(spark, folder, "submissions"), out, f"{work.root}/state").awaitTermination()
    return spark.read.parquet(out).select("rid", "code_hash", "token_count", "schema_version")


@query("""
with gone as (select domain_id, min(tid) tid from pairs group by domain_id)
select domain_id, tid, count(*) n, count(distinct (rid1, rid2)) n_pairs from pairs where (domain_id, tid) not in (select domain_id, tid from gone) group by all""")
def pairs_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs written by contest, written again, and the first contest of every domain replaced by none."""
    root = f"{Workspace(spark, 'stored').root}/pairs"
    rows = table(spark, folder, "pairs").select("domain_id", "tid", "rid1", "rid2", "level", "similarity")
    every = rows.select("domain_id", "tid").distinct()
    for _ in range(2):
        store.replace_pairs(rows, root, every)
    store.replace_pairs(rows.limit(0), root, every.groupBy("domain_id").agg(F.min("tid").alias("tid")))
    return store.read_pairs(spark, root).groupBy("domain_id", "tid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("rid1", "rid2")).alias("n_pairs"))


@query(f"""with {sql.TEXTS}, {sql.HASHED}, old as (select rid, max(coalesce(schema_version, 0)) version from features where rid is not null group by rid)
select coalesce(made.rid, old.rid) rid, case when made.rid is not null and 3 >= coalesce(version, 0) then 3 else version end schema_version, case when made.rid is not null and 3 >= coalesce(version, 0) then code_hash end code_hash
from made full join old on old.rid = made.rid""")
def features_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Features made anew put in place of cached ones, where these are not of a higher version: one row a rid."""
    source = latest.source_text(table(spark, folder, "submissions")).where((F.col("source") != "") & F.col("rid").isNotNull())
    made = with_artifacts(source.groupBy("rid").agg(F.min("lang").alias("lang"), F.min("source").alias("source")), "source", "lang").withColumn("new_hash", F.col("code_hash"))
    out = store.upsert_features(table(spark, folder, "features"), made)
    return out.select("rid", F.coalesce("schema_version", F.lit(0)).alias("schema_version"), F.col("new_hash").alias("code_hash"))
