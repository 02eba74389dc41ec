"""Read side: filters, pages, per-user rollups, relationship graph and line diff over a pairs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprint.functions import hashing, metrics
from kinprint.operators.skew import ranked_rows, salted_join
from kinprint.session import Workspace

PAGE = 50
GRAPH_LIMIT = 20_000
#: Pairs of a report at most.
REPORT_CAP = 50_000
RATIO_METRICS = {"seq": "sim_seq", "lex": "sim_lex", "tfidf": "sim_tfidf", "var": "sim_var", "func": "sim_func", "struct": "sim_struct"}


def pair_filter(pairs: DataFrame, min_level: int = 1, pid: int | None = None, user: int | None = None, metric: str | None = None, at_least: float | None = None) -> DataFrame:
    """Pairs of a level (1 to 3) or above; of a problem; with a user on either side; with a metric at a value.

    metric: a key of RATIO_METRICS, whose value is a percentage (70 if not given), or
    'comments', a count (1 if not given).  A null metric never matches.
    """
    out = pairs.where(F.col("level") >= min(3, max(1, min_level)))
    if pid is not None:
        out = out.where(F.col("pid") == pid)
    if user is not None:
        out = out.where((F.col("uid1") == user) | (F.col("uid2") == user))
    if metric == "comments":
        out = out.where(F.col("shared_comments") >= (1 if at_least is None else int(at_least + 0.5)))
    elif metric in RATIO_METRICS:
        out = out.where(F.col(RATIO_METRICS[metric]) >= (70 if at_least is None else at_least) / 100)
    return out


def page(pairs: DataFrame, number: int = 1, metric: str | None = None, size: int = PAGE) -> DataFrame:
    """One page: by similarity downwards and pid, or with a ratio metric by pid and the metric downwards; ties by all ids."""
    ties = ["uid1", "uid2", "rid1", "rid2"]
    order = [F.col("pid"), F.desc(RATIO_METRICS[metric])] if metric in RATIO_METRICS else [F.desc("similarity"), F.col("pid")]
    return pairs.orderBy(*order, *ties).offset(max(0, number - 1) * size).limit(size)


def capped(pairs: DataFrame, keys: list[str], most: int, work: Workspace) -> DataFrame:
    """The first `most` pairs of each key by similarity downwards, pid and ids.

    As on a page, null similarities come last (after NaN) and null ids first.  No row may stand twice.
    The cut is found by histograms (see skew.ranked_rows), so a key of any size is never sorted in one task.
    """
    ids = ["pid", "uid1", "uid2", "rid1", "rid2"]
    # ranked_rows takes no null: each order column is a flag for its nulls and a value without them.
    scored = F.when(F.isnan("similarity"), 1).when(F.col("similarity").isNull(), 2).otherwise(0)
    columns = {"__neg0": scored, "__neg1": F.when(scored == 0, -F.col("similarity")).otherwise(0.0)}
    for c in ids:
        columns |= {f"__{c}0": F.col(c).isNotNull().cast("int"), f"__{c}1": F.coalesce(c, F.lit(0))}
    order = list(columns)
    rows = pairs.withColumns(columns)
    cut = ranked_rows(work.write(rows.select(*keys, *order)), keys, order, work, F.least(F.col("__n"), F.lit(most)))
    cut = cut.select(*keys, F.struct(*order).alias("__cut"))
    return salted_join(rows, cut, keys, ["rid1", "rid2"]).where(F.struct(*order) <= F.col("__cut")).select(pairs.columns)


def sides(pairs: DataFrame) -> DataFrame:
    """Every pair seen from both users: uid, partner, own flags and the pair's columns."""
    one = lambda a, b: F.struct(F.col(f"uid{a}").alias("uid"), F.col(f"uid{b}").alias("partner"), F.col(f"flags{a}").alias("flags"))
    return pairs.select("domain_id", "tid", "pid", "similarity", "level", "shared_comments", F.explode(F.array(one(1, 2), one(2, 1))).alias("s")).select("domain_id", "tid", "pid", "similarity", "level", "shared_comments", "s.*")


def user_summary(pairs: DataFrame) -> DataFrame:
    """Per user: pairs, pairs by level, highest similarity, pairs with shared comments, and the union of the user's own flags."""
    return sides(pairs).where(F.col("uid").isNotNull()).groupBy("uid").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == n).alias(f"l{n}") for n in (3, 2, 1)],
        F.max("similarity").alias("max_similarity"), F.count_if(F.col("shared_comments") > 0).alias("comment_pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("flags", F.array().cast("array<string>")))))).alias("flags"),
    )


def user_problem(pairs: DataFrame) -> DataFrame:
    """Per user and problem: pairs, highest similarity and different partners."""
    return sides(pairs).where(F.col("uid").isNotNull()).groupBy("uid", "pid").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("similarity").alias("max_similarity"), F.count_distinct("partner").alias("partners"))


def graph_edges(pairs: DataFrame, titles: DataFrame, min_level: int = 1) -> DataFrame:
    """Edges u, v of the user network with the problem's title ('P' and its id where it has none)."""
    named = pairs.where(F.col("level") >= min_level).join(titles, "pid", "left")
    return named.select(F.col("uid1").alias("u"), F.col("uid2").alias("v"), "similarity", "level", "pid", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("P"), F.col("pid"))).alias("title"))


def graph_nodes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Users of the edges with degree (parallel edges count), highest level and name ('U' and the id where there is none)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("uid"), "level")
    nodes = ends.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.count(F.lit(1)).alias("degree"), F.max("level").alias("max_level"))
    return nodes.join(names, "uid", "left").select("uid", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("U"), F.col("uid"))).alias("name"), "degree", "max_level")


def graph_stats(pairs: DataFrame, min_level: int = 1) -> DataFrame:
    """Counts by level over all pairs, and the users that are left from the least level on."""
    end = lambda n: F.struct(F.col(f"uid{n}").alias("uid"), F.lit(n == 1).alias("first"))
    ends = pairs.select("level", F.explode(F.array(end(1), end(2))).alias("e")).select("level", "e.*")
    counts = [F.count_if(F.col("first") & (F.col("level") == n)).alias(f"l{n}") for n in (1, 2, 3)]
    return ends.agg(F.count_if("first").alias("total"), *counts, F.count_distinct(F.when(F.col("level") >= min_level, F.col("uid"))).alias("users"))


def visible_edges(edges: DataFrame, levels: list[int]) -> DataFrame:
    """Edges of the chosen levels; all edges if none of these levels occurs."""
    chosen = edges.where(F.col("level").isin(levels))
    return chosen if chosen.take(1) else edges


def strongest(pairs: DataFrame, most: int = GRAPH_LIMIT) -> DataFrame:
    """The most similar pairs, for a graph that can still be drawn; ties by all ids."""
    return pairs.orderBy(F.desc("similarity"), "pid", "uid1", "uid2", "rid1", "rid2").limit(most)


def cut_line(line: Column, most: int = 500) -> Column:
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def side_by_side(df: DataFrame, left: str, right: str, ids: list[str]) -> DataFrame:
    """Lines of two texts beside each other, cut to 500 characters: ids, row (from 1), left_line, right_line."""
    a, b = hashing.split_lines(F.col(left)), hashing.split_lines(F.col(right))
    rows = df.select(*ids, F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("row", "z"))
    return rows.select(*ids, (F.col("row") + 1).alias("row"), cut_line(F.col("z.a")).alias("left_line"), cut_line(F.col("z.b")).alias("right_line"))


def line_diffs(df: DataFrame, left: str, right: str, ids: list[str]) -> DataFrame:
    """Diff rows of two texts: ids, row, l, r, type; no rows for texts above the cell limit."""
    diff = metrics.line_diff(hashing.split_lines(F.col(left)), hashing.split_lines(F.col(right)))
    return df.select(*ids, diff.alias("d")).select(*ids, F.posexplode("d").alias("row", "x")).select(*ids, (F.col("row") + 1).alias("row"), "x.l", "x.r", "x.type")
