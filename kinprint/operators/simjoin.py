"""Similarity self-join of groups within a scope by an inverted index on k-gram hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.functions.hashing import round4
from kinprint.functions.metrics import dice
from kinprint.operators import overlap
from kinprint.operators.groups import SCOPE

TRIVIAL_MEDIAN, TRIVIAL_PAIRS = 0.8, 10
#: Groups of one hash that meet each other in one task at most; more are cut into blocks.
BLOCK = 5_000
#: Meetings an entry of the index above which the prefix filter pays (measured: 5 an entry 4.0 s counted, 9.0 s filtered; 79 an entry 21 s and 12 s).
DENSE = 30


def _meetings(entries: DataFrame, scope: list[str], sizes: DataFrame | None, close) -> DataFrame:
    """Pairs of entries (scope, hash, rep, n) of one hash with rep1 < rep2 that pass a test of n1 and n2.

    sizes: scope, hash, df where a hash has more than BLOCK entries somewhere.  Such hashes are cut
    into blocks, and every pair of blocks is a join key of its own, so no task meets more than two blocks.
    """
    key = [*scope, "hash"]
    if sizes is not None:
        many = sizes.where(F.col("df") > BLOCK).select(*key, F.ceil(F.col("df") / BLOCK).cast("int").alias("nb")).hint("merge")
        entries = entries.join(many, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.hash("rep"), F.col("nb")))
        entries = entries.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(*key, "rep", "n", "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"))
        key += ["p", "q"]
    a, b = (entries.select(*key, *[F.col(c).alias(f"{c}{k}") for c in entries.columns if c not in key]) for k in (1, 2))
    test = (F.col("rep1") < F.col("rep2")) & close(F.col("n1"), F.col("n2"))
    if sizes is not None:
        test = test & ((F.col("p") == F.col("q")) | (F.col("blk1") != F.col("blk2")))
    return a.join(b, key).where(test)


def _entries(groups: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inverted index (scope, hash, rep, n) and the entries of each hash (scope, hash, df)."""
    entries = groups.select(*scope, "rep", F.size("fps").alias("n"), F.explode("fps").alias("hash"))
    return entries, entries.groupBy(*scope, "hash").agg(F.count(F.lit(1)).alias("df"))


def _counted(meetings: DataFrame, scope: list[str]) -> DataFrame:
    out = meetings.groupBy(*scope, "rep1", "rep2").agg(F.count(F.lit(1)).alias("common"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    return out.withColumn("sim", 2.0 * F.col("common") / (F.col("n1") + F.col("n2")))


def overlapping_pairs(groups: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """All pairs of groups of a scope with a common hash: rep1 < rep2, common, sim.

    groups: scope columns, rep, fps (distinct values).  Pairs are counted where both sets are
    (operators/overlap), so the shuffle holds sets and not the meetings of their hashes.
    """
    return overlap.common_counts(groups, scope).withColumn("sim", 2.0 * F.col("common") / (F.col("n1") + F.col("n2")))


def pairs_at_least(groups: DataFrame, threshold: float, scope: list[str] = SCOPE, dense: int = DENSE) -> DataFrame:
    """Exactly the pairs of overlapping_pairs with sim >= threshold > 0.

    Sets whose sizes differ too much never meet.  With up to `dense` meetings an entry all common
    hashes are counted.  Where there are more, frequent hashes cause most of them, and a prefix filter
    keeps those out: of a set of n hashes, put in order of rising frequency, any partner within the
    threshold shares one of the first n - ceil(n * t / (2 - t)) + 1, and candidates are
    verified on whole sets.  Both ways give the same pairs.
    """
    share = threshold / (2 - threshold)
    close = lambda a, b: F.least(a, b) >= F.lit(share - 1e-9) * F.greatest(a, b)
    entries, sizes = _entries(groups, scope)
    total, meetings, most = sizes.agg(F.sum("df"), F.sum(F.col("df") * F.col("df")), F.max("df")).first()
    large = sizes if (most or 0) > BLOCK else None
    if (meetings or 0) <= dense * (total or 0):
        return _counted(_meetings(entries, scope, large, close), scope).where(F.col("sim") >= threshold)
    # Hashes of one group only cannot make a pair, but they fill its prefix.
    ordered = entries.join(sizes.hint("merge"), [*scope, "hash"]).groupBy(*scope, "rep").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("h"))
    n = F.size("h")
    prefix = F.slice("h", F.lit(1), (n - F.ceil(n * F.lit(share) - 1e-9) + 1).cast("int"))
    keys = ordered.select(*scope, "rep", n.alias("n"), F.explode(prefix).alias("e")).where(F.col("e.df") > 1).select(*scope, F.col("e.hash").alias("hash"), "rep", "n")
    found = _meetings(keys, scope, large, close).select(*scope, "rep1", "rep2").distinct()
    left = groups.select(*scope, F.col("rep").alias("rep1"), F.col("fps").alias("f1"))
    right = groups.select(*scope, F.col("rep").alias("rep2"), F.col("fps").alias("f2"))
    both = found.join(left, [*scope, "rep1"]).join(right, [*scope, "rep2"])
    out = both.select(*scope, "rep1", "rep2", F.size(F.array_intersect("f1", "f2")).cast("bigint").alias("common"), F.size("f1").alias("n1"), F.size("f2").alias("n2"), dice(F.col("f1"), F.col("f2")).alias("sim"))
    return out.where(F.col("sim") >= threshold)


def histogram(pairs: DataFrame, groups: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Pairs of groups of every scope by similarity in hundredths: scope, bucket, n.

    pairs need not hold pairs of similarity 0; all pairs not given count in bucket 0.
    Scopes of one group have no row.
    """
    seen = pairs.groupBy(*scope, F.least(F.lit(100), F.floor(F.col("sim") * 100 + 0.5)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return _with_rest(seen, groups, scope)


def full_histogram(groups: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """histogram() of all pairs of groups, of which none is listed."""
    seen = overlap.common_buckets(groups, scope).groupBy(*scope, "bucket").agg(F.sum("n").alias("n"))
    return _with_rest(seen, groups, scope)


def _with_rest(seen: DataFrame, groups: DataFrame, scope: list[str]) -> DataFrame:
    sizes = groups.groupBy(*scope).agg(F.count(F.lit(1)).alias("g"))
    zero = sizes.select(*scope, F.lit(0).alias("bucket"), F.expr("g * (g - 1) div 2").alias("n"))
    # seen is read once: what it takes from bucket 0 stands beside it.
    both = seen.select(*scope, F.explode(F.array(F.struct("bucket", "n"), F.struct(F.lit(0).alias("bucket"), (-F.col("n")).alias("n")))).alias("x")).select(*scope, "x.*")
    return both.unionByName(zero).groupBy(*scope, "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def medians(hist: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Per scope the number of pairs, their median similarity in hundredths / 100, and whether the problem is saturated."""
    out = hist.groupBy(*scope).agg(F.sum("n").alias("n_pairs"), (F.percentile("bucket", F.lit(0.5), F.col("n")) / 100).alias("median"))
    return out.withColumn("trivial", (F.col("median") >= TRIVIAL_MEDIAN) & (F.col("n_pairs") >= TRIVIAL_PAIRS))


__all__ = ["overlapping_pairs", "pairs_at_least", "histogram", "full_histogram", "medians", "round4"]
