"""The scan: from submissions to classified pairs with their evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.functions import hashing, metrics
from kinprint.functions.artifacts import with_artifacts
from kinprint.functions.metrics import Thresholds
from kinprint.operators import groups as grouping
from kinprint.operators import latest, simjoin
from kinprint.operators.groups import SCOPE
from kinprint.operators.skew import hot_join, hot_values, salted_join
from kinprint.plans.report import capped
from kinprint.session import Workspace

#: A group with more pairs (and more than a thousandth of all) is salted where pairs meet its features.
HUB = 50_000
FEATURES = ["code_hash", "token_count", "hashes", "base_hashes", "lex_base_hashes", "tf", "struct_vec", "funcs", "idents", "comment_hashes", "flags"]


@dataclass(frozen=True)
class ScanConfig:
    """Settings of a scan; see plans.config for reading them from loose values."""

    k: int = 8
    min_tokens: int = 0
    max_code_size: int = 1_048_576
    mode: str = "latest"
    ignore_cache: bool = False
    exclude_pids: tuple[int, ...] = ()
    max_pairs: int | None = None  # of a contest, the most similar ones
    thresholds: Thresholds = field(default_factory=Thresholds)


def collect(submissions: DataFrame, config: ScanConfig) -> DataFrame:
    """The submissions to compare: the latest of each user and problem, or all (each rid once), without excluded problems."""
    rows = submissions.where(F.col("rid").isNotNull())
    if config.exclude_pids:
        rows = rows.where(~F.coalesce(F.col("pid").isin(list(config.exclude_pids)), F.lit(False)))
    return latest.latest_submissions(rows) if config.mode == "latest" else latest.latest_per_key(rows, ["rid"], ["domain_id", "tid"])


def featured(rows: DataFrame, features: DataFrame | None, config: ScanConfig, blobs: DataFrame | None = None) -> DataFrame:
    """Collected rows with their features: cached ones where current, else computed; skipped rows have a reason.

    Columns: scope, rid, uid, lang, hit, reason, and FEATURES (null if skipped).  Hash
    values are brought to unsigned numbers.
    """
    rows = rows.select(*SCOPE, "rid", "uid", "lang", "code", "files_code")
    if features is None or config.ignore_cache:
        hits, misses = None, rows
    else:
        cached = latest.usable(features, config.k).select("rid", *FEATURES)
        hits = rows.drop("code", "files_code").join(cached, "rid").withColumn("hit", F.lit(True))
        current = features.where((F.col("k") == config.k) & (F.col("schema_version") == 3)).select("rid").distinct()
        misses = rows.join(current, "rid", "left_anti")
    fetched = latest.source_text(misses, blobs).drop("code", "files_code")
    # Misses come out of a shuffle, so the lexing is spread already.
    early = latest.skip_reason(F.col("source"), None, config.max_code_size)
    made = with_artifacts(fetched.withColumn("reason", early).withColumn("source", F.when(early.isNull(), F.col("source"))), "source", "lang", config.k)
    made = made.withColumn("reason", F.coalesce("reason", F.when(F.col("token_count") < config.min_tokens, "short")))
    made = made.select(*SCOPE, "rid", "uid", "lang", F.lit(False).alias("hit"), "reason", *FEATURES)
    out = made if hits is None else hits.withColumn("reason", F.lit(None).cast("string")).select(made.columns).unionByName(made)
    for c in ("base_hashes", "lex_base_hashes"):
        out = out.withColumn(c, hashing.unsigned(F.col(c)))
    return out.withColumn("hashes", hashing.unsigned_set(F.col("hashes"))).withColumn("comment_hashes", hashing.unsigned_set(F.col("comment_hashes")))


def term_vectors(groups: DataFrame) -> DataFrame:
    """Per group the map from term to tf * ln(1 + groups / df) within its scope (null for an empty tf)."""
    sizes = groups.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_groups"))
    df = grouping.document_frequency(groups).join(sizes, SCOPE)
    terms = groups.select(*SCOPE, "rep", F.explode("tf").alias("term", "n")).where(F.col("n").isNotNull())
    weighed = salted_join(terms, df, [*SCOPE, "term"], ["rep"])
    weight = F.col("n") * F.log(1 + F.col("n_groups") / F.greatest(F.lit(1), F.col("df")))
    return weighed.groupBy(*SCOPE, "rep").agg(F.map_from_entries(F.collect_list(F.struct("term", weight.alias("w")))).alias("weights"))


def group_evidence(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups with sim_seq, sim_tfidf, sim_func and sim_struct.

    A group that is similar to very many meets its pairs in several tasks (hot_join).
    """
    n = pairs.count()
    hubs = {c: hot_values(pairs, c, HUB, total=n) if n > HUB else [] for c in ("rep1", "rep2")}
    art = groups.select(*SCOPE, "rep", "base_hashes", "struct_vec", "funcs", hashing.family(F.col("lang")).alias("family")).join(term_vectors(groups), [*SCOPE, "rep"], "left")
    side = lambda n: art.select(*SCOPE, *[F.col(c).alias(f"{c}{n}") for c in art.columns if c not in SCOPE])
    both = hot_join(pairs, side(1), "rep1", hubs["rep1"], "rep2", also=tuple(SCOPE))
    both = hot_join(both, side(2), "rep2", hubs["rep2"], "rep1", also=tuple(SCOPE))
    c = F.col
    return both.select(
        *SCOPE, "rep1", "rep2", "sim", "common",
        metrics.seq_similarity("base_hashes1", "base_hashes2").alias("sim_seq"),
        metrics.map_cosine(c("weights1"), c("weights2")).alias("sim_tfidf"),
        F.when(c("family1") == c("family2"), metrics.func_similarity(c("funcs1"), c("funcs2"))).alias("sim_func"),
        metrics.cosine(c("struct_vec1"), c("struct_vec2")).alias("sim_struct"),
    )


def scan(submissions: DataFrame, features: DataFrame | None, work: Workspace, config: ScanConfig = ScanConfig(), blobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, scanned rows, saturation per scope) of all contests at once.

    Features and group pairs are written once and read by the later steps, so no
    Arrow function runs twice.  Pairs come with all metrics at four decimals.
    """
    t = config.thresholds
    newest = config.mode == "latest"
    docs_all = work.write(featured(collect(submissions, config), features, config, blobs))
    docs = docs_all.where(F.col("reason").isNull())
    carried = ("token_count", "hashes", "base_hashes", "tf", "struct_vec", "funcs", "lang")
    groups = work.write(grouping.code_groups(docs, SCOPE, carried, newest))
    members = grouping.group_members(docs, SCOPE, newest)
    fps = groups.select(*SCOPE, "rep", F.col("hashes").alias("fps"))
    # The median is at least 0.8 only if the lower of two middle pairs is at least 0.6: pairs below 0.55 need no exact bucket.
    found = work.write(simjoin.pairs_at_least(fps, min(t.suspected, 0.55)))
    state = simjoin.medians(simjoin.histogram(found, groups)).select(*SCOPE, "trivial")
    crossing = group_evidence(found.where(F.col("sim") >= t.suspected), groups)
    one = F.lit(1.0)
    same = groups.where(F.lit(1.0) >= t.suspected).select(*SCOPE, F.col("rep").alias("rep1"), F.col("rep").alias("rep2"), one.alias("sim"), F.col("token_count").cast("bigint").alias("common"), one.alias("sim_seq"), one.alias("sim_tfidf"), one.alias("sim_func"), one.alias("sim_struct"))
    pairs = work.write(crossing.unionByName(same))

    reps = groups.select(*SCOPE, "code_hash", "rep")
    lexical = hashing.as_set(hashing.kgrams(F.col("lex_base_hashes"), config.k))
    named = docs.select("rid", lexical.alias("lex"), "idents", "comment_hashes", "flags").dropDuplicates(["rid"])
    own = members.join(reps, [*SCOPE, "code_hash"]).select(*SCOPE, "rep", "uid", "rid", "lang")
    side = lambda n: own.select(*SCOPE, *[F.col(c).alias(f"{c}{n}") for c in ("rep", "uid", "rid", "lang")])
    wide = pairs.join(side(1), [*SCOPE, "rep1"]).join(side(2), [*SCOPE, "rep2"])
    wide = wide.where((F.col("uid1") != F.col("uid2")) & ((F.col("rep1") != F.col("rep2")) | (F.col("uid1") < F.col("uid2"))))
    swap = F.col("uid1") > F.col("uid2")
    for c in ("uid", "rid", "lang"):
        first, second = F.when(swap, F.col(f"{c}2")).otherwise(F.col(f"{c}1")), F.when(swap, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
        wide = wide.withColumn(f"__{c}1", first).withColumn(f"__{c}2", second)
    wide = wide.select(*SCOPE, "sim", "common", "sim_seq", "sim_tfidf", "sim_func", "sim_struct", *[F.col(f"__{c}{n}").alias(f"{c}{n}") for c in ("uid", "rid", "lang") for n in (1, 2)])
    for n in (1, 2):
        wide = wide.join(named.select(*[F.col(c).alias(f"{c}{n}") for c in named.columns]), f"rid{n}")
    wide = salted_join(wide, state, SCOPE, ["rid1", "rid2"], "left")
    wide = wide.withColumn("sim_lex", metrics.dice_or_null(F.col("lex1"), F.col("lex2"))).withColumn("sim_var", metrics.var_similarity(F.col("idents1"), F.col("idents2")))
    level = metrics.classify_pair(F.col("sim"), F.col("sim_lex"), F.col("sim_var"), F.coalesce("trivial", F.lit(False)), t)
    ratios = ("sim_seq", "sim_lex", "sim_tfidf", "sim_var", "sim_func", "sim_struct")
    flags = [F.when(F.size(f"flags{n}") > 0, F.col(f"flags{n}")).alias(f"flags{n}") for n in (1, 2)]
    out = wide.withColumn("level", level).where(F.col("level") >= 1).select(
        *SCOPE, "uid1", "uid2", "rid1", "rid2", "lang1", "lang2", hashing.round4(F.col("sim")).alias("similarity"), "level", F.col("common").cast("int").alias("common"),
        *[hashing.round4(F.col(c)).alias(c) for c in ratios], metrics.shared_count(F.col("comment_hashes1"), F.col("comment_hashes2")).alias("shared_comments"), *flags,
    )
    if config.max_pairs is not None:
        out = capped(work.write(out), ["domain_id", "tid"], config.max_pairs, work)
    return out, docs_all, state


def report_stats(docs: DataFrame, pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Per contest: users, submissions, skipped by reason, cache hits, pairs by level, saturated problems."""
    keys = ["domain_id", "tid"]
    scanned = F.col("reason").isNull()
    seen = docs.groupBy(*keys).agg(
        F.count_distinct(F.when(scanned, F.col("uid"))).alias("users"), F.count_if(scanned).alias("submissions"), F.count_if(~scanned).alias("skipped"),
        *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"skipped_{r}") for r in ("short", "big", "empty")], F.count_if(F.col("hit")).alias("cache_hits"),
    )
    found = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("level") == n).alias(f"l{n}") for n in (1, 2, 3)])
    flat = state.where("trivial").groupBy(*keys).agg(F.array_sort(F.collect_set("pid")).alias("trivial_pids"))
    out = seen.join(found, keys, "left").join(flat, keys, "left")
    return out.fillna(0, ["pairs", "l1", "l2", "l3"]).withColumn("trivial_pids", F.coalesce("trivial_pids", F.array().cast("array<bigint>")))
