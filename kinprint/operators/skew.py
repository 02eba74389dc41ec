"""Operators for keys that hold a large part of all rows.

No step here gathers the rows of one key in one task: hot keys are met by
map-side combining (only compact partial states are shuffled) or by salting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprint.session import Workspace

SALTS = 16
BUCKETS = 1024
#: A group of at most so many rows is small enough to be sorted in one task.
SORTABLE = 20_000


def salted_join(rows: DataFrame, states: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows a key with at most one state a key.

    Each state is repeated once for each salt and the rows are spread over the
    salts by the columns in spread, so a key with a third of all rows lands in
    `salts` tasks.  Keys compare null-safe.  Adaptive execution turns the join
    into a broadcast only if the states' real size is below the session's limit.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = states.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in states.columns if c not in on], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    test = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__{c}"]) for c in on], left["__salt"] == right["__s"])
    return left.join(right, test, how).drop("__salt", "__s", *[f"__{c}" for c in on])


def hot_values(df: DataFrame, column: str, least: int, most: int = 1000, total: int | None = None) -> list:
    """Values of a column that hold more than max(least, rows/most) rows: never more than `most` of them.

    total: the rows of df, or more, where they are known.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.count() if total is None else total
    return [r[0] for r in counts.where((F.col("n") > max(least, total // most)) & F.col(column).isNotNull()).select(column).collect()]


def hot_join(rows: DataFrame, states: DataFrame, column: str, hot: list, spread: str, how: str = "inner", salts: int = SALTS, also: tuple[str, ...] = ()) -> DataFrame:
    """Join rows and states on one column of the same name (and others in also), of which a few known values hold many rows.

    hot: those values (see hot_values).  Their rows are spread over salts by another
    column, and only their states are repeated for each salt; without hot values it is a plain join.
    """
    if not hot:
        return rows.join(states, [*also, column], how)
    left = rows.withColumn("__salt", F.when(F.col(column).isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.when(F.col(column).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(states.withColumn("__salt", F.explode(copies)), [*also, column, "__salt"], how).drop("__salt")


def _picked(pieces: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(pieces):
        out = F.when(test, value).otherwise(out)
    return out


def ranked_rows(df: DataFrame, keys: list[str], order: list[str], work: Workspace, rank: Column, sortable: int = SORTABLE) -> DataFrame:
    """For each key its row of a rank (from 1) in ascending order; rank is an expression of __n, the key's rows.

    df holds the columns keys + order only, no row twice and no null in order;
    keys may be null and nulls form a group.  An empty input gives an empty result.

    The rank is found by histograms: each pass counts the rows of every key in
    up to 1024 ranges between its current bounds (a combining aggregate, so a
    hot key shuffles at most 1024 states per task), keeps the range that holds
    the rank, and goes on to the next order column where a column has a single
    value left.  Passes end when no key has more than `sortable` rows in its range.
    """
    low, high = [f"__lo{i}" for i in range(len(order))], [f"__hi{i}" for i in range(len(order))]
    bounds = [f for c, a, b in zip(order, low, high) for f in (F.min(c).alias(a), F.max(c).alias(b))]
    state = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *bounds).withColumn("__rank", rank.cast("bigint"))
    state = work.write(state)

    def inside(s: DataFrame) -> DataFrame:
        joined = salted_join(df, s, keys, order)
        return joined.where(reduce(lambda a, b: a & b, [F.col(c).between(F.col(x), F.col(y)) for c, x, y in zip(order, low, high)]))

    while True:
        open_ = state.where((F.col("__n") > sortable) & reduce(lambda a, b: a | b, [F.col(x) < F.col(y) for x, y in zip(low, high)]))
        if not open_.take(1):
            break
        part = [(F.col(x) < F.col(y), F.floor((F.col(c) - F.col(x)).cast("double") / (F.col(y) - F.col(x)).cast("double") * (BUCKETS - 1))) for c, x, y in zip(order, low, high)]
        rows = inside(open_).select(*keys, *order, "__rank", _picked(part, F.lit(0)).alias("__b"))
        counted = rows.groupBy(*keys, "__rank", "__b").agg(F.count(F.lit(1)).alias("__n"), *bounds)
        upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chosen = (
            counted.withColumn("__upto", F.sum("__n").over(upto))
            .where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
            .withColumn("__rank", F.col("__rank") - (F.col("__upto") - F.col("__n")))
            .select(state.columns)
        )
        settled = state.where(~((F.col("__n") > sortable) & reduce(lambda a, b: a | b, [F.col(x) < F.col(y) for x, y in zip(low, high)])))
        narrowed = work.write(settled.unionByName(chosen))
        work.drop(state)
        state = narrowed
    ranked = inside(state).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__i") == F.col("__rank")).select(*keys, *order)


def middle_rows(df: DataFrame, keys: list[str], order: list[str], work: Workspace, sortable: int = SORTABLE) -> DataFrame:
    """For each key the row number floor((n+1)/2) of its n rows in ascending order."""
    return ranked_rows(df, keys, order, work, F.expr("(__n + 1) div 2"), sortable)


def middle_pairs(pairs: DataFrame, work: Workspace, sortable: int = SORTABLE) -> DataFrame:
    """The middle pair by similarity of every (tid, pid): tid, pid, rid1, rid2.

    Rows with a null rid, a null or NaN similarity or the same rid on both sides
    do not count.  The smaller rid stands first, and a pair counts once for each
    (tid, pid); should its rows differ in similarity, the largest counts.  Ties
    are broken by rid1 and rid2.  Null tids and pids form groups of their own.
    """
    ok = F.col("rid1").isNotNull() & F.col("rid2").isNotNull() & F.col("similarity").isNotNull() & ~F.isnan("similarity") & (F.col("rid1") != F.col("rid2"))
    rows = pairs.where(ok).select("tid", "pid", F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"), "similarity")
    once = work.write(rows.groupBy("tid", "pid", "rid1", "rid2").agg(F.max("similarity").alias("similarity")))
    return middle_rows(once, ["tid", "pid"], ["similarity", "rid1", "rid2"], work, sortable).select("tid", "pid", "rid1", "rid2")


def key_profile(pairs: DataFrame) -> DataFrame:
    """Per (tid, pid): rows, rows with a similarity, its least, mean and greatest value.

    All states are algebraic, so Spark combines them in bounded hash tables on
    the map side and shuffles one compact row per key and task, however hot a key is.
    """
    return pairs.groupBy("tid", "pid").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("similarity").alias("n_scored"),
        F.min("similarity").alias("min_similarity"),
        F.avg(F.col("similarity").cast("decimal(20,8)")).cast("double").alias("mean_similarity"),
        F.max("similarity").alias("max_similarity"),
    )
