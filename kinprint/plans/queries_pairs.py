"""Read-side queries over the whole pairs table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import hashing, metrics
from kinprint.operators import latest
from kinprint.plans import report
from kinprint.plans import sql_lexer as sql
from kinprint.plans.registry import query
from kinprint.session import Workspace
from kinprint.sources.tables import table

_IDS = "tid, pid, uid1, uid2, rid1, rid2"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pairs")


def _ids(df: DataFrame, *more) -> DataFrame:
    return df.select("tid", "pid", "uid1", "uid2", "rid1", "rid2", *more)


@query("""select tid, pid, rid1, rid2, similarity, case when similarity >= 0.95 then 3 when similarity >= 0.75 then 2 when similarity >= 0.55 then 1 else 0 end as level_now from pairs""")
def classify(spark: SparkSession, folder: str) -> DataFrame:
    """Level by similarity alone."""
    return _pairs(spark, folder).select("tid", "pid", "rid1", "rid2", "similarity", metrics.classify(F.col("similarity")).alias("level_now"))


@query("""
select tid, pid, rid1, rid2,
  case when similarity >= 0.95 then case when coalesce(sim_lex >= 0.85, false) or coalesce(sim_var >= 0.6, false) then 3 else 2 end when similarity >= 0.75 then 2 when similarity >= 0.55 then 1 else 0 end normal,
  case when coalesce(sim_lex, similarity) >= 0.95 and coalesce(sim_var >= 0.8, true) then 3 when coalesce(sim_lex, similarity) >= 0.75 then 2 when coalesce(sim_lex, similarity) >= 0.55 then 1 else 0 end saturated
from pairs""")
def classify_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Level by both channels, for an ordinary and for a saturated problem."""
    s, x, v = F.col("similarity"), F.col("sim_lex"), F.col("sim_var")
    return _pairs(spark, folder).select("tid", "pid", "rid1", "rid2", metrics.classify_pair(s, x, v, F.lit(False)).alias("normal"), metrics.classify_pair(s, x, v, F.lit(True)).alias("saturated"))


@query("""
with c as (select *, case when similarity >= 0.95 then case when coalesce(sim_lex >= 0.85, false) or coalesce(sim_var >= 0.6, false) then 3 else 2 end when similarity >= 0.75 then 2 when similarity >= 0.55 then 1 else 0 end as l from pairs)
select domain_id, tid, l as level_now, count(*) n from c where l >= 1 group by all""")
def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that reach a level, per contest and level."""
    level = metrics.classify_pair(F.col("similarity"), F.col("sim_lex"), F.col("sim_var"), F.lit(False))
    return _pairs(spark, folder).withColumn("level_now", level).where(F.col("level_now") >= 1).groupBy("domain_id", "tid", "level_now").agg(F.count(F.lit(1)).alias("n"))


@query("select level, ['none', 'suspected', 'high', 'identical'][level + 1] as label, count(*) n from pairs group by all")
def level_label(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the levels that occur."""
    return _pairs(spark, folder).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", metrics.level_label(F.col("level")).alias("label"), "n")


@query("""
select rid1, rid2, floor(sim_lex * 1000 + 0.5) / 10 pct, case when sim_lex is null then 'na' when sim_lex >= 0.7 then 'high' when sim_lex >= 0.4 then 'mid' else 'low' end heat from pairs""")
def heat_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Display percentage and colour band of the lexical metric."""
    return _pairs(spark, folder).select("rid1", "rid2", metrics.percent(F.col("sim_lex")).alias("pct"), metrics.heat(F.col("sim_lex")).alias("heat"))


@query(f"select {_IDS}, similarity, level from pairs where level >= 2")
def pair_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of level 2 and above."""
    return _ids(report.pair_filter(_pairs(spark, folder), 2), "similarity", "level")


@query(f"select 'lex' as metric, {_IDS} from pairs where level >= 1 and sim_lex >= 0.7 union all select 'comments', {_IDS} from pairs where level >= 1 and shared_comments >= 1")
def metric_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by a metric at its usual value."""
    rows = _pairs(spark, folder)
    return _ids(report.pair_filter(rows, metric="lex"), F.lit("lex").alias("metric")).unionByName(_ids(report.pair_filter(rows, metric="comments"), F.lit("comments").alias("metric")))


@query("select uid, count(*) n_rows, count(distinct pid) problems from (select uid1 uid, pid from pairs union all select uid2, pid from pairs where uid2 is distinct from uid1) where uid is not null group by uid")
def user_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in which a user stands on either side, for every user."""
    ends = _pairs(spark, folder).select("pid", F.explode(F.array_distinct(F.array("uid1", "uid2"))).alias("uid")).where(F.col("uid").isNotNull())
    return ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pid").alias("problems"))


@query(f"select {_IDS}, similarity from pairs where level >= 1 order by similarity desc nulls last, pid nulls first, uid1 nulls first, uid2 nulls first, rid1 nulls first, rid2 nulls first limit 50 offset 50")
def pair_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of all pairs."""
    return _ids(report.page(report.pair_filter(_pairs(spark, folder)), 2), "similarity")


@query(f"select {_IDS}, sim_lex from pairs where level >= 1 and sim_lex >= 0.7 order by pid nulls first, sim_lex desc nulls last, uid1 nulls first, uid2 nulls first, rid1 nulls first, rid2 nulls first limit 50")
def metric_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page by problem and lexical metric."""
    return _ids(report.page(report.pair_filter(_pairs(spark, folder), metric="lex"), 1, "lex"), "sim_lex")


_CLEAN = "select distinct on (tid, pid, rid1, rid2) tid, pid, uid1, uid2, rid1, rid2, similarity from pairs where similarity is not null and uid1 is not null and uid2 is not null and rid1 is not null and rid2 is not null and tid is not null and pid is not null order by tid, pid, rid1, rid2, similarity desc, uid1 desc, uid2 desc"


@query(f"select {_IDS}, similarity from (select *, row_number() over (partition by tid order by -similarity, pid, uid1, uid2, rid1, rid2) i from ({_CLEAN})) where i <= 200")
def pair_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 most similar pairs of every contest, of the rows that lack nothing (pair_report: a report's own cap, all rows)."""
    names = ["tid", "pid", "uid1", "uid2", "rid1", "rid2", "similarity"]
    rows = _pairs(spark, folder).select(*names).dropna(subset=names)
    once = latest.latest_per_key(rows, ["tid", "pid", "rid1", "rid2"], ["similarity", "uid1", "uid2"])
    work = Workspace(spark, "cap")
    return report.capped(work.write(once), ["tid"], 200, work).select(*names)


_ONE_EACH = "select distinct on (tid, pid, rid1, rid2, case when rid1 is null or rid2 is null then uid1 end, case when rid1 is null or rid2 is null then uid2 end) tid, pid, uid1, uid2, rid1, rid2, similarity from pairs order by tid, pid, rid1, rid2, case when rid1 is null or rid2 is null then uid1 end, case when rid1 is null or rid2 is null then uid2 end, similarity desc nulls last, uid1 desc nulls last, uid2 desc nulls last"


@query(f"select {_IDS}, similarity from (select *, row_number() over (partition by tid order by similarity desc nulls last, pid nulls first, uid1 nulls first, uid2 nulls first, rid1 nulls first, rid2 nulls first) i from ({_ONE_EACH})) where i <= {report.REPORT_CAP}")
def pair_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair once, of a contest the 50 000 most similar ones at most; rows without an id or a similarity count, too.

    Rows that lack a rid are the same pair only if they agree in the users as well.
    """
    names = ["tid", "pid", "uid1", "uid2", "rid1", "rid2", "similarity"]
    user = lambda n: F.when(F.col("rid1").isNull() | F.col("rid2").isNull(), F.col(f"uid{n}"))
    rows = _pairs(spark, folder).select(*names, user(1).alias("__u1"), user(2).alias("__u2"))
    once = latest.latest_per_key(rows, ["tid", "pid", "rid1", "rid2", "__u1", "__u2"], ["similarity", "uid1", "uid2"])
    work = Workspace(spark, "report")
    return report.capped(work.write(once.select(*names)), ["tid"], report.REPORT_CAP, work)


_SIDES = """sides as (select uid1 uid, uid2 partner, flags1 flags, pid, similarity, level, shared_comments from pairs union all select uid2, uid1, flags2, pid, similarity, level, shared_comments from pairs)"""


@query(f"""with {_SIDES}, f as (select uid, string_agg(distinct x, ',' order by x) flags from (select uid, unnest(flags) x from sides) group by uid)
select uid, count(*) total, count_if(level = 3) l3, count_if(level = 2) l2, count_if(level = 1) l1, max(similarity) max_similarity, count_if(shared_comments > 0) comment_pairs, coalesce(any_value(f.flags), '') flags
from sides left join f using (uid) where uid is not null group by uid""")
def user_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every user."""
    return report.user_summary(_pairs(spark, folder)).withColumn("flags", F.array_join("flags", ","))


@query(f"with {_SIDES} select uid, pid, count(*) n_pairs, max(similarity) max_similarity, count(distinct partner) partners from sides where uid is not null group by uid, pid")
def user_problem(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every user and problem."""
    return report.user_problem(_pairs(spark, folder))


_TITLES = "titles as (select pid, coalesce(min(title), '') title from (select unnest(pids) pid, trim(title) title from contests) group by pid)"


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "contests").select(F.explode("pids").alias("pid"), F.trim("title").alias("title"))
    return rows.groupBy("pid").agg(F.coalesce(F.min("title"), F.lit("")).alias("title"))


@query(f"with {_TITLES} select uid1 u, uid2 v, similarity, level, p.pid, coalesce(nullif(title, ''), concat('P', p.pid)) title from pairs p left join titles using (pid) where level >= 2")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the user network from level 2 on."""
    return report.graph_edges(_pairs(spark, folder), _titles(spark, folder), 2)


#: The customers stand in for the users' table: their keys are those of users, less 100 000.
_USERS = "names as (select c_custkey + 100000 uid, c_name as name from customer)"


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select((F.col("c_custkey") + 100_000).alias("uid"), F.col("c_name").alias("name"))


@query(f"""with {_USERS}, e as (select uid1 uid, level from pairs where level >= 2 union all select uid2, level from pairs where level >= 2)
select uid, coalesce(nullif(any_value(name), ''), concat('U', uid)) as name, count(*) degree, max(level) max_level from e left join names using (uid) where uid is not null group by uid""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Users of the network from level 2 on, with their names."""
    return report.graph_nodes(report.graph_edges(_pairs(spark, folder), _titles(spark, folder), 2), _users(spark, folder))


@query("""select 'pid' as what, tid, pid, uid1, uid2, rid1, rid2 from pairs where level >= 1 and pid = 1014 union all select 'user', tid, pid, uid1, uid2, rid1, rid2 from pairs where level >= 1 and (uid1 = 100047 or uid2 = 100047)""")
def one_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one problem, and pairs with one user on either side."""
    rows = _pairs(spark, folder)
    return _ids(report.pair_filter(rows, pid=1014), F.lit("pid").alias("what")).unionByName(_ids(report.pair_filter(rows, user=100047), F.lit("user").alias("what")))


@query("""select uid1 u, uid2 v, similarity, pid, level from (select * from pairs order by similarity desc nulls last, pid nulls first, uid1 nulls first, uid2 nulls first, rid1 nulls first, rid2 nulls first limit 20000)""")
def graph_strongest(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of a graph of the 20 000 most similar pairs at most."""
    return report.graph_edges(report.strongest(_pairs(spark, folder)), _titles(spark, folder)).select("u", "v", "similarity", "pid", "level")


@query("""select count(*) total, count_if(level = 1) l1, count_if(level = 2) l2, count_if(level = 3) l3,
  (select count(distinct u) from (select uid1 u from pairs where level >= 2 union all select uid2 from pairs where level >= 2)) users from pairs""")
def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the network."""
    return report.graph_stats(_pairs(spark, folder), 2)


@query(f"with {_TITLES} select distinct p.pid, coalesce(nullif(title, ''), concat('P', p.pid)) title from pairs p left join titles using (pid)")
def graph_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of the network with their titles."""
    return report.graph_edges(_pairs(spark, folder).withColumn("level", F.lit(1)), _titles(spark, folder)).select("pid", "title").distinct()


@query("""with e as (select uid1, uid2, level from pairs where level in (1, 3)), n as (select uid1 uid, level from e union all select uid2, level from e)
select uid, count(*) degree, max(level) max_level from n where uid is not null group by uid""")
def graph_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Users of the network with only levels 1 and 3 shown."""
    edges = _pairs(spark, folder).select(F.col("uid1").alias("u"), F.col("uid2").alias("v"), "level")
    return report.graph_nodes(report.visible_edges(edges, [1, 3]), _users(spark, folder)).drop("name")


_TEXTS = "texts as (select rid, any_value(case when files_code <> '' then '' else coalesce(code, '') end) t from submissions group by rid), p as (select distinct rid1, rid2 from pairs where rid1 is not null and rid2 is not null)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded pairs with the inline source of both sides."""
    source = latest.source_text(table(spark, folder, "submissions")).select("rid", "source").dropDuplicates(["rid"])
    rows = _pairs(spark, folder).select("rid1", "rid2").where(F.col("rid1").isNotNull() & F.col("rid2").isNotNull()).distinct()
    for n in (1, 2):
        rows = rows.join(source.select(F.col("rid").alias(f"rid{n}"), F.col("source").alias(f"text{n}")), f"rid{n}")
    return rows


@query(f"""with {_TEXTS}, l as (select rid1, rid2, string_split(replace(a.t, chr(13) || chr(10), chr(10)), chr(10)) x, string_split(replace(b.t, chr(13) || chr(10), chr(10)), chr(10)) y
  from p join texts a on a.rid = rid1 join texts b on b.rid = rid2 where a.t <> '' and b.t <> ''),
z as (select rid1, rid2, unnest(range(1, greatest(len(x), len(y)) + 1)) as row, x, y from l)
select rid1, rid2, row, case when length(x[row]) > 500 then left(x[row], 500) || '…' else x[row] end left_line, case when length(y[row]) > 500 then left(y[row], 500) || '…' else y[row] end right_line from z""")
def diff_degraded(spark: SparkSession, folder: str) -> DataFrame:
    """Lines beside each other for recorded pairs with both sources inline."""
    return report.side_by_side(_texts(spark, folder).where((F.col("text1") != "") & (F.col("text2") != "")), "text1", "text2", ["rid1", "rid2"]).withColumn("row", F.col("row").cast("bigint"))


@query(rf"""with recursive {_TEXTS}, l as (select rid1, rid2, string_split(replace(a.t, chr(13) || chr(10), chr(10)), chr(10)) x, string_split(replace(b.t, chr(13) || chr(10), chr(10)), chr(10)) y
  from p join texts a on a.rid = rid1 join texts b on b.rid = rid2 where a.t <> '' and b.t <> ''),
m as (select rid1, rid2, list_transform(x, lambda z: regexp_replace(z, '^{sql._BLANKS}|{sql._BLANKS}$', '', 'g')) x, list_transform(y, lambda z: regexp_replace(z, '^{sql._BLANKS}|{sql._BLANKS}$', '', 'g')) y from l where len(x) * len(y) <= {metrics.CELL_LIMIT}),
both_ as materialized (select row_number() over () id, x a, y b from (select distinct x, y from m)), {sql.LCS}
select rid1, rid2, n eq, len(x) - n del, len(y) - n ins, 0 wrong from m join both_ on both_.a = x and both_.b = y join lcs using (id)""")
def diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each line diff by kind, and those that are wrong: equal rows of unequal lines, or line numbers that do not follow one another."""
    texts = _texts(spark, folder).where((F.col("text1") != "") & (F.col("text2") != ""))
    ids = ["rid1", "rid2"]
    lines = texts.select(*ids, hashing.split_lines(F.col("text1")).alias("x"), hashing.split_lines(F.col("text2")).alias("y"))
    rows = lines.select(*ids, "x", "y", metrics.line_diff("x", "y").alias("d")).where(F.col("d").isNotNull())
    of = lambda kind: F.filter("d", lambda r: r["type"] == kind)
    bare = lambda c: F.regexp_replace(c, f"^[{hashing._BLANK}]+|[{hashing._BLANK}]+$", "")
    unequal = F.size(F.filter(of("eq"), lambda r: bare(F.get(F.col("x"), r["l"] - 1)) != bare(F.get(F.col("y"), r["r"] - 1))))
    numbers = lambda side, n: (F.filter(F.transform("d", lambda r: r[side]), lambda v: v.isNotNull()) != F.sequence(F.lit(1), n)).cast("int")
    return rows.select(*ids, *[F.size(of(k)).cast("bigint").alias(k) for k in ("eq", "del", "ins")], (unequal + numbers("l", F.size("x")) + numbers("r", F.size("y"))).alias("wrong"))


@query()
def line_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Line diffs of recorded pairs with both sources inline."""
    return report.line_diffs(_texts(spark, folder).where((F.col("text1") != "") & (F.col("text2") != "")), "text1", "text2", ["rid1", "rid2"])
