"""Queries on groups of equal sources and their similarity join, over the latest submission of every user and problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import hashing, metrics
from kinprint.operators import groups as grouping
from kinprint.operators import latest, simjoin
from kinprint.operators.groups import SCOPE
from kinprint.plans import scan
from kinprint.plans import sql_lexer as sql
from kinprint.plans.registry import query
from kinprint.session import Workspace
from kinprint.sources.tables import table

_U32 = "list_sort(list_distinct(list_transform(coalesce({0}, []), lambda x: x & 4294967295)))"
FEATS = "feats as (select * from (select *, row_number() over (partition by rid order by rid) i from features where k = 8 and schema_version = 3) where i = 1)"
DOCS = f"""{sql.FEATURES},
newest as (select domain_id, tid, pid, uid, max(rid) rid from submissions where rid is not null group by all),
docs as (select n.domain_id, n.tid, n.pid, n.uid, n.rid, f.* exclude (rid) from newest n join feats f using (rid))"""
GROUPS = f"""{DOCS},
groups as (select domain_id, tid, pid, code_hash, max(rid) rep, count(*) n_docs, arg_max(hashes, rid) fps, arg_max(tf, rid) tf, arg_max(struct_vec, rid) struct_vec, arg_max(token_count, rid) token_count from docs group by domain_id, tid, pid, code_hash)"""
PAIRS = f"""{GROUPS},
entries as (select domain_id, tid, pid, rep, len(fps) n, unnest(fps) h from groups),
found as (select a.domain_id, a.tid, a.pid, a.rep rep1, b.rep rep2, count(*) common, 2.0 * count(*) / (any_value(a.n) + any_value(b.n)) sim
  from entries a join entries b on a.domain_id = b.domain_id and a.tid = b.tid and a.pid = b.pid and a.h = b.h and a.rep < b.rep group by all)"""
R4 = "floor({0} * 10000 + 0.5) / 10000"
HIST = f"""{PAIRS},
seen as (select domain_id, tid, pid, least(100, floor(sim * 100 + 0.5))::int bucket, count(*) n from found group by all),
sizes as (select domain_id, tid, pid, count(*) g from groups group by all),
hist as (select domain_id, tid, pid, bucket, sum(n)::bigint n from (
  select * from seen union all select domain_id, tid, pid, 0, g * (g - 1) // 2 from sizes union all select domain_id, tid, pid, 0, -n from seen)
  group by all having sum(n) > 0)"""
MEDIAN = f"""{HIST},
run as (select *, sum(n) over (partition by domain_id, tid, pid order by bucket) upto, sum(n) over (partition by domain_id, tid, pid) total from hist),
medians as (select domain_id, tid, pid, any_value(total)::bigint n_pairs,
  (min(case when upto >= (total + 1) // 2 then bucket end) + min(case when upto >= total // 2 + 1 then bucket end)) / 2.0 / 100 median from run group by domain_id, tid, pid)"""


def _featured(spark: SparkSession, folder: str) -> DataFrame:
    """The latest submissions with their features, as the scan has them: cached ones, and the others lexed."""
    config = scan.ScanConfig()
    docs = scan.featured(scan.collect(table(spark, folder, "submissions"), config), table(spark, folder, "features"), config)
    return docs.where(F.col("reason").isNull())


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Those submissions, written once."""
    return Workspace(spark, "docs").write(_featured(spark, folder))


def _groups(spark: SparkSession, folder: str, *carried: str) -> DataFrame:
    return grouping.code_groups(_docs(spark, folder), SCOPE, carried)


def _fps(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with their fingerprint sets, written once; the submissions are read once, so they need no table."""
    groups = grouping.code_groups(_featured(spark, folder).select(*SCOPE, "rid", "code_hash", "hashes"), SCOPE, ("hashes",))
    return Workspace(spark, "fps").write(groups.select(*SCOPE, "rep", F.col("hashes").alias("fps")))


@query(f"with {GROUPS} select domain_id, tid, pid, code_hash, rep, n_docs from groups")
def code_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal normalised sources."""
    return _groups(spark, folder)


@query(f"with {DOCS} select domain_id, tid, pid, code_hash, uid, max(rid) rid from docs group by all")
def group_members(spark: SparkSession, folder: str) -> DataFrame:
    """One submission of each user in each group."""
    return grouping.group_members(_docs(spark, folder)).drop("lang")


@query(f"with {GROUPS}, terms as (select domain_id, tid, pid, unnest(map_keys(tf)) term from groups) select domain_id, tid, pid, term, count(*) df from terms group by all")
def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that have a term, per problem."""
    return grouping.document_frequency(_groups(spark, folder, "tf"))


@query(f"with {PAIRS} select domain_id, tid, pid, rep1, rep2, common, {R4.format('sim')} similarity from found")
def group_dice(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of groups of a problem with a common k-gram."""
    return simjoin.overlapping_pairs(_fps(spark, folder)).select(*SCOPE, "rep1", "rep2", "common", hashing.round4(F.col("sim")).alias("similarity"))


@query(f"with {PAIRS} select domain_id, tid, pid, rep1, rep2, common, {R4.format('sim')} similarity from found where sim >= 0.55")
def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of groups at the lowest threshold, by prefix and size filters."""
    return simjoin.pairs_at_least(_fps(spark, folder), 0.55).select(*SCOPE, "rep1", "rep2", "common", hashing.round4(F.col("sim")).alias("similarity"))


@query(f"with {HIST} select domain_id, tid, pid, bucket, n from hist")
def sim_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of groups by similarity in hundredths, the pairs without overlap included."""
    return simjoin.full_histogram(_fps(spark, folder))


@query(f"with {MEDIAN} select domain_id, tid, pid, n_pairs, median from medians")
def sim_median(spark: SparkSession, folder: str) -> DataFrame:
    """Median similarity per problem."""
    return simjoin.medians(simjoin.full_histogram(_fps(spark, folder))).drop("trivial")


@query(f"with {MEDIAN} select domain_id, tid, pid, median >= 0.8 and n_pairs >= 10 as trivial from medians")
def trivial_pids(spark: SparkSession, folder: str) -> DataFrame:
    """Saturated problems; pairs below 0.55 need no exact bucket for this."""
    fps = _fps(spark, folder)
    return simjoin.medians(simjoin.histogram(simjoin.pairs_at_least(fps, 0.55), fps)).select(*SCOPE, "trivial")


@query(f"""with {DOCS}
select a.domain_id, a.tid, a.pid, a.uid uid1, b.uid uid2, a.rid rid1, b.rid rid2 from docs a join docs b
on a.domain_id = b.domain_id and a.tid = b.tid and a.pid = b.pid and a.code_hash = b.code_hash and a.uid < b.uid""")
def member_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of users within a group, the smaller user first."""
    m = grouping.group_members(_docs(spark, folder)).drop("lang")
    key = [*SCOPE, "code_hash"]
    a, b = (m.select(*key, F.col("uid").alias(f"uid{n}"), F.col("rid").alias(f"rid{n}")) for n in (1, 2))
    return a.join(b, key).where(F.col("uid1") < F.col("uid2")).drop("code_hash").select(*SCOPE, "uid1", "uid2", "rid1", "rid2")


# --- metrics of the recorded pairs, from the features of both sides ---


def _both(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Recorded pairs, each once, with columns of both sides' features as <column>1 and <column>2."""
    pairs = table(spark, folder, "pairs").select("rid1", "rid2").where(F.col("rid1").isNotNull() & F.col("rid2").isNotNull()).distinct()
    feats = latest.usable(table(spark, folder, "features")).select("rid", *columns)
    for n in (1, 2):
        pairs = pairs.join(feats.select(F.col("rid").alias(f"rid{n}"), *[F.col(c).alias(f"{c}{n}") for c in columns]), f"rid{n}")
    return pairs


def _two(column: str, expr: str = "{0}") -> str:
    return f"""{FEATS}, p as (select distinct rid1, rid2 from pairs where rid1 is not null and rid2 is not null),
v as (select rid, {expr.format(column)} v from feats),
b as (select rid1, rid2, x.v a, y.v b from p join v x on x.rid = rid1 join v y on y.rid = rid2)"""


_DICE = "case when len(a) = 0 or len(b) = 0 then {0} else 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) end"


@query(f"with {_two('hashes', _U32)} select rid1, rid2, len(list_intersect(a, b)) common, {R4.format(_DICE.format('0.0'))} similarity from b")
def dice_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Structural similarity of the recorded pairs, anew."""
    rows = _both(spark, folder, "hashes").select("rid1", "rid2", *[hashing.unsigned_set(F.col(f"hashes{n}")).alias(c) for n, c in ((1, "a"), (2, "b"))])
    return rows.select("rid1", "rid2", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), hashing.round4(metrics.dice(F.col("a"), F.col("b"))).alias("similarity"))


_LEXGRAMS = """list_sort(list_distinct(case when len({0}) < 8 then [] else list_transform(range(1, len({0}) - 6), lambda j:
  list_reduce(list_prepend(0::bigint, list_transform({0}[j:j+7], lambda y: y & 4294967295)), lambda h, x: (h * 16777619 + x) & 4294967295)) end))"""


@query(f"with {_two('lex_base_hashes', _LEXGRAMS)} select rid1, rid2, {R4.format('(' + _DICE.format('null') + ')')} sim_lex from b")
def lex_dice(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical similarity of the recorded pairs; the k-grams are made once a submission."""
    pairs = table(spark, folder, "pairs").select("rid1", "rid2").where(F.col("rid1").isNotNull() & F.col("rid2").isNotNull()).distinct()
    grams = latest.usable(table(spark, folder, "features")).select("rid", hashing.as_set(hashing.kgrams(hashing.unsigned(F.col("lex_base_hashes")), 8)).alias("g"))
    for n in (1, 2):
        pairs = pairs.join(grams.select(F.col("rid").alias(f"rid{n}"), F.col("g").alias(f"g{n}")), f"rid{n}")
    return pairs.select("rid1", "rid2", hashing.round4(metrics.dice_or_null(F.col("g1"), F.col("g2"))).alias("sim_lex"))


_NAMES = "list_distinct(list_filter(coalesce({0}, []), lambda x: length(x) > 2 and not list_contains([" + ", ".join(f"'{n}'" for n in metrics.COMMON_NAMES if len(n) > 2) + "], x)))"


@query(f"with {_two('idents', _NAMES)} select rid1, rid2, {R4.format('(' + _DICE.format('null') + ')')} sim_var from b")
def var_dice(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of telling names of the recorded pairs."""
    return _both(spark, folder, "idents").select("rid1", "rid2", hashing.round4(metrics.var_similarity(F.col("idents1"), F.col("idents2"))).alias("sim_var"))


@query(f"with {_two('comment_hashes', _U32)} select rid1, rid2, len(list_intersect(a, b)) shared_comments from b")
def shared_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comment lines the recorded pairs share."""
    rows = _both(spark, folder, "comment_hashes")
    shared = metrics.shared_count(hashing.unsigned_set(F.col("comment_hashes1")), hashing.unsigned_set(F.col("comment_hashes2")))
    return rows.select("rid1", "rid2", shared.cast("bigint").alias("shared_comments"))


_COS = "case when list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x)) > 0 then list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) end"


@query(f"with {_two('struct_vec', 'list_transform({0}, lambda x: x::double)')} select rid1, rid2, round({_COS}, 6) sim_struct from b where len(a) > 0 and len(b) > 0")
def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the structure profiles of the recorded pairs."""
    rows = _both(spark, folder, "struct_vec").where((F.size("struct_vec1") > 0) & (F.size("struct_vec2") > 0))
    return rows.select("rid1", "rid2", F.round(metrics.cosine(F.col("struct_vec1"), F.col("struct_vec2")), 6).alias("sim_struct"))


@query(f"""with {_two('funcs')},
l as (select rid1, rid2, unnest(a) f from b), r as (select rid1, rid2, unnest(b) f, generate_subscripts(b, 1) i from b),
lm as (select rid1, rid2, f.hash h, min(f.len) n from l group by all), rm as (select rid1, rid2, f.hash h, arg_min(f.len, i) n from r group by all),
m as (select rid1, rid2, sum(least(lm.n, rm.n)) s from lm join rm using (rid1, rid2, h) group by all),
t as (select rid1, rid2, coalesce(list_sum(list_transform(a, lambda f: f.len)), 0) + coalesce(list_sum(list_transform(b, lambda f: f.len)), 0) w from b)
select rid1, rid2, {R4.format('(case when w > 0 then 2.0 * coalesce(s, 0) / w end)')} sim_func from t left join m using (rid1, rid2)""")
def func_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Function-body similarity of the recorded pairs."""
    return _both(spark, folder, "funcs").select("rid1", "rid2", hashing.round4(metrics.func_similarity(F.col("funcs1"), F.col("funcs2"))).alias("sim_func"))


@query(f"""with {FEATS}, n as (select count(*) n from feats), t as (select rid, unnest(map_entries(tf)) e from feats),
d as (select e.key k, count(*) df from t group by all), w as (select rid, e.key k, e.value * ln(1 + n.n::double / df) w from t join d on d.k = e.key cross join n where e.value is not null),
q as (select rid, sum(w * w) q from w group by all), p as (select distinct rid1, rid2 from pairs where rid1 is not null and rid2 is not null),
dot as (select rid1, rid2, sum(x.w * y.w) s from p join w x on x.rid = rid1 join w y on y.rid = rid2 and y.k = x.k group by all)
select rid1, rid2, round(coalesce(s, 0) / sqrt(a.q * b.q), 6) sim_tfidf from p join q a on a.rid = rid1 join q b on b.rid = rid2 left join dot using (rid1, rid2) where a.q > 0 and b.q > 0""")
def tfidf_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the keyword vectors of the recorded pairs, weighed over all counted features."""
    from kinprint.operators.skew import salted_join

    feats = latest.usable(table(spark, folder, "features")).select("rid", "tf")
    n = feats.count()
    df = feats.select(F.explode(F.map_keys("tf")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = salted_join(feats.select("rid", F.explode("tf").alias("term", "n")).where(F.col("n").isNotNull()), df, ["term"], ["rid"])
    vectors = terms.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("n") * F.log(1 + F.lit(float(n)) / F.col("df"))).alias("w")))).alias("v"))
    pairs = table(spark, folder, "pairs").select("rid1", "rid2").where(F.col("rid1").isNotNull() & F.col("rid2").isNotNull()).distinct()
    for k in (1, 2):
        pairs = pairs.join(vectors.select(F.col("rid").alias(f"rid{k}"), F.col("v").alias(f"v{k}")), f"rid{k}")
    out = pairs.select("rid1", "rid2", F.round(metrics.map_cosine(F.col("v1"), F.col("v2")), 6).alias("sim_tfidf"))
    return out.where(F.col("sim_tfidf").isNotNull())


@query(f"""with recursive {_two('base_hashes', sql._U32)}, ok as (select * from b where len(a) > 0 and len(b) > 0 and len(a) * len(b) <= {metrics.CELL_LIMIT}),
both_ as materialized (select row_number() over () id, a, b from (select distinct a, b from ok)), {sql.LCS}
select rid1, rid2, {R4.format('2 * n / (len(b.a) + len(b.b))')} sim_seq from b left join both_ on both_.a = b.a and both_.b = b.b left join lcs using (id)""")
def seq_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Token-sequence similarity (longest common subsequence) of the recorded pairs."""
    rows = _both(spark, folder, "base_hashes").select("rid1", "rid2", *[hashing.unsigned(F.col(f"base_hashes{n}")).alias(f"b{n}") for n in (1, 2)])
    return rows.select("rid1", "rid2", hashing.round4(metrics.seq_similarity("b1", "b2")).alias("sim_seq"))
