"""Groups of linked records: connected components over pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprint.operators.skew import SALTS, hot_values
from kinprint.session import Workspace

#: A vertex with more links than this (and more than a thousandth of all) is salted in joins.
HOT = 50_000
#: Tables of at most so many rows may be broadcast (below 1 MB); larger ones meet by sort and merge.
SMALL = 10_000
#: Edges that a task contracts at a time: the bound on its memory.
HELD = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges a-b but for the roots, and the smallest vertex of each one's component within these edges."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    inner = np.flatnonzero(label != np.arange(len(ids)))
    return ids[inner], ids[label[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (k, a, b) of one partition as stars of the same components: the rounds then see forests of depth 1."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def done() -> Iterator[pa.RecordBatch]:
        k, a, b = (np.concatenate(c) for c in zip(*held))
        for kind in np.unique(k):
            at = k == kind
            member, root = local_roots(a[at], b[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(member), kind), pa.int32()), pa.array(member), pa.array(root)], names=["k", "a", "b"])

    for batch in batches:
        held.append(tuple(np.asarray(c) for c in batch.columns))
        n += batch.num_rows
        if n >= HELD:
            yield from done()
            held, n = [], 0
    if n:
        yield from done()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (k, a, b) with the same components, each partition's own contracted to stars; null ends, loops and repeats fall away."""
    rows = edges.where(F.col("a") != F.col("b")).select(F.col("k").cast("int").alias("k"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    return rows.mapInArrow(_contract, "k int, a bigint, b bigint")


def _follow(rows: DataFrame, column: str, parents: DataFrame, hot: list, spread: str, n_parents: int) -> DataFrame:
    """Replace rows[column] by its parent where it has one of the same kind k.

    Rows of hot values are spread over salts by another column; only the few
    parents that are hot (at most a thousand) are repeated for each salt.
    n_parents bounds the parents' rows; above SMALL they are never broadcast.
    """
    if n_parents > SMALL:
        parents = parents.hint("merge")
    parents = parents.select(F.col("k").alias("__k"), F.col("v").alias("__v"), F.col("p").alias("__p"))
    test = (F.col("k") == F.col("__k")) & (F.col(column) == F.col("__v"))
    if hot:
        rows = rows.withColumn("__salt", F.when(F.col(column).isin(hot), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
        salts = F.when(F.col("__v").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        parents = parents.withColumn("__s", F.explode(salts))
        test = test & (F.col("__salt") == F.col("__s"))
    return rows.join(parents, test, "left").withColumn(column, F.coalesce("__p", column)).drop("__k", "__v", "__p", "__s", "__salt")


def linked_labels(edges: DataFrame, work: Workspace, hot: int = HOT) -> DataFrame:
    """Label every vertex of the edges (k, a, b) with the smallest vertex of its component: (k, v, p).

    Edges of different kinds k never meet; all kinds are solved by the same jobs.
    Every partition first contracts its own edges (contracted).
    Each round then takes the smallest label across a vertex's edges as its parent,
    follows parents to their roots by pointer jumping, and rewrites the edges
    between roots; every step's table is written to the checkpoint folder, and
    the rows that changed are counted while it is written.  The rounds end when
    no edge joins two labels.  Each round at least halves the roots of a
    component, so rounds are few even for chains of any length.
    Edges with a null end, loops and repeats add nothing; no edges give no rows.
    """

    def hubs(df: DataFrame, column: str, n: int) -> list:
        return hot_values(df, column, hot, total=n) if n > hot else []

    def canonical(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def composed(steps: list[DataFrame], n: int) -> DataFrame:
        """Labels through several steps of parents: one plan for few rows, else a table a step, whose hubs are known."""
        out = steps[0]
        for i, parents in enumerate(steps[1:], 2):
            out = _follow(out, "p", parents.where(F.col("p") != F.col("v")), hubs(out, "p", n), "v", n)
            if n > hot or i == len(steps):
                out = work.write(out)
        for parents in steps:
            work.drop(parents)
        return out

    every: Column = F.lit(True)
    live, n = work.write_counted(canonical(contracted(edges)), every)
    steps: list[DataFrame] = []
    n_first = 0
    while n:
        both = live.unionByName(live.select("k", F.col("b").alias("a"), F.col("a").alias("b")))
        parents, n_parents = work.write_counted(both.groupBy("k", F.col("a").alias("v")).agg(F.min("b").alias("p")).select("k", "v", F.least("v", "p").alias("p")), every)
        n_first = n_first or n_parents
        changed = 1
        while changed:
            inner = parents.where(F.col("p") != F.col("v"))
            hot_parents = hubs(inner, "p", n_parents)
            hopped = parents.select("k", "v", "p", F.col("p").alias("q"))
            # Few rows go two hops a table; of many only the first hop's hubs are known.
            for _ in range(1 if n_parents > hot else 2):
                hopped = _follow(hopped, "p", inner, hot_parents, "v", n_parents)
            jumped, changed = work.write_counted(hopped, F.col("p") != F.col("q"))
            work.drop(parents)
            parents = jumped
        moved = _follow(live, "a", parents, hubs(live, "a", n), "b", n_parents)
        moved = _follow(moved, "b", parents, hubs(live, "b", n), "a", n_parents)
        rest, m = work.write_counted(canonical(moved), every)
        work.drop(live)
        live, n = rest, m
        steps.append(parents)
        if len(steps) == 4:
            steps = [composed(steps, n_first)]
    if not steps:
        return live.select("k", F.col("a").alias("v"), F.col("b").alias("p"))
    return (steps[0] if len(steps) == 1 else composed(steps, n_first)).select("k", "v", "p")


def connected_components(edges: DataFrame, work: Workspace, hot: int = HOT) -> DataFrame:
    """Components of edges (a, b) of one kind: every vertex v with its component's smallest vertex p."""
    return linked_labels(edges.select(F.lit(0).alias("k"), "a", "b"), work, hot).select("v", "p")


def grouped_members(sides: DataFrame, work: Workspace) -> DataFrame:
    """Every non-null id of sides (k, a, b) with its group's smallest id: k, member_id, group_id.

    A row with both ids links them.  A row with one null id links nothing, but
    the other id is a member; one that is linked to none but itself is its own group.
    """
    members = sides.select("k", F.explode(F.array("a", "b")).alias("member_id")).where(F.col("member_id").isNotNull()).distinct()
    labels = linked_labels(sides, work).select(F.col("k").alias("__k"), "v", "p")
    joined = members.join(labels, (F.col("k") == F.col("__k")) & (F.col("member_id") == F.col("v")), "left")
    return joined.select("k", "member_id", F.coalesce("p", "member_id").alias("group_id"))


def pair_groups(pairs: DataFrame, work: Workspace) -> DataFrame:
    """Groups of submissions (kind rid) and of users (kind uid): kind, member_id, group_id."""
    side = lambda k, name: F.struct(F.lit(k).alias("k"), F.col(f"{name}1").cast("bigint").alias("a"), F.col(f"{name}2").cast("bigint").alias("b"))
    sides = pairs.select(F.explode(F.array(side(0, "rid"), side(1, "uid"))).alias("s")).select("s.*")
    return grouped_members(sides, work).select(F.when(F.col("k") == 0, "rid").otherwise("uid").alias("kind"), "member_id", "group_id")
