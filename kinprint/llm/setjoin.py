"""All similar pairs between set-valued records, by multi-index binary sketches.

One-bit minhashes are packed into codes.  A code is cut into segments, and rows
that agree in a segment (up to a few probed bits) are compared by the Hamming
distance of their codes; by the pigeonhole principle codes within a radius
agree in a segment, and the number of segments and the radius are calibrated so
that a pair at the threshold is found with the stated recall.  What passes is
verified on the original sets, so no false pair is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.llm.buckets import CAP, WORDS, near_pairs
from kinprint.llm.sketches import digests, near_share, one_bit_minhashes, pack_words, ragged_sets, segments_needed, tail_radius
from kinprint.operators.skew import hot_join, hot_values, salted_join
from kinprint.session import Workspace, spread

RECALL = 0.9998
#: An id with more pairs (and more than a thousandth of all) is salted where pairs meet their sets or copies.
HUB = 50_000
#: Copies of one set that meet each other in one task, about.
COPIES = 2_000


class Plan:
    """Segment length and count, probed bits and radius for a Jaccard threshold.

    Of all lengths (and, with queries, of up to `probes` probed bits) the cheapest is taken:
    rows sent to buckets, plus a twentieth of the comparisons that unlike rows cause there.
    So length grows with the logarithm of the number of rows, and buckets keep their size.
    """

    def __init__(self, threshold: float, rows: int, recall: float = RECALL, queries: int | None = None, probes: int = 2):
        p = (1 - threshold) / 2
        rows = max(rows, 2)

        def choice(length: int, probe: int) -> tuple:
            count = segments_needed(near_share(length, p, probe), recall)
            sent = rows if queries is None else rows + queries * sum(math.comb(length, e) for e in range(probe + 1))
            meetings = rows * rows / 2 if queries is None else rows * (sent - rows)
            return count * (sent + meetings / 2**length / 20), length, probe, count

        tried = [choice(length, probe) for length in range(8, 31) for probe in (range(probes + 1) if queries else (0,))]
        _, self.length, self.probe, self.count = min(tried)
        self.threshold = threshold
        self.radius = tail_radius(64 * WORDS, p, 1 - (1 - recall) / 4)
        self.bits = max(self.length * self.count, 64 * WORDS)


_SKETCH = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int32()), *[(f"c{k}", pa.int64()) for k in range(WORDS)], ("segments", pa.list_(pa.int64()))])
_SKETCH_DDL = "id bigint, d1 bigint, d2 bigint, size int, " + ", ".join(f"c{k} bigint" for k in range(WORDS)) + ", segments array<bigint>"


def _sketcher(plan: Plan, probing: bool):
    length, count, bits = plan.length, plan.count, plan.bits
    flips = [0] + [sum(1 << b for b in c) for e in range(1, plan.probe + 1) for c in combinations(range(length), e)] if probing else [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(length, dtype=np.int64)
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            values, offsets = ragged_sets(batch.column(1))
            matrix = one_bit_minhashes(values, offsets, bits)
            keys = matrix[:, : length * count].reshape(len(matrix), count, length).astype(np.int64) @ weights
            keys = (keys[:, :, None] ^ np.array(flips, dtype=np.int64)) | (np.arange(count, dtype=np.int64) << 32)[None, :, None]
            keys = keys.reshape(len(matrix), -1)
            words = pack_words(matrix[:, : 64 * WORDS])
            a, b = digests(values, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(np.diff(offsets).astype(np.int32)), *[pa.array(words[:, k]) for k in range(WORDS)], lists], schema=_SKETCH)

    return run


def sketch_classes(sets: DataFrame, plan: Plan, work: Workspace, probing: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row for each different non-empty set, and the membership of ids in it.

    sets has the columns id and elems.  Returns (classes: rep, size, c0.., segments;
    members: id, rep), where rep is the smallest id with the set.
    """
    made = work.write(spread(sets.select("id", "elems")).mapInArrow(_sketcher(plan, probing), _SKETCH_DDL).where(F.col("size") > 0))
    key = ["d1", "d2", "size"]
    classes = made.groupBy(*key).agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in [f"c{k}" for k in range(WORDS)] + ["segments"]])
    reps = made.groupBy(*key).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")).where(F.col("n") > 1).select(*key, "rep")
    copies = salted_join(made.select("id", *key), reps.hint("merge"), key, ["id"]).select("id", "rep").distinct()
    out = work.write(classes.select("rep", "size", *[f"c{k}" for k in range(WORDS)], "segments")), work.write(copies)
    work.drop(made)
    return out


def low32(column: str) -> F.Column:
    """A list column as the ascending array of its distinct low 32 bits (signed)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(F.col(column), F.array().cast("array<bigint>")), lambda x: x.isNotNull()), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))))


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, test, n: int) -> DataFrame:
    """The n pairs (id1, id2) whose sets pass test(common, size1, size2): id1, id2, common, size1, size2.

    left and right have id and elems; an id with several (equal) rows is taken once.
    An id with a large part of all pairs is salted: its pairs meet its set in several tasks.
    Sets grow with the data, so they are not broadcast.
    """
    hubs = {k: hot_values(pairs, k, HUB, total=n) if n > HUB else [] for k in ("id1", "id2")}
    pick = lambda s, k: s.select(F.col("id").alias(f"id{k}"), low32("elems").alias(f"s{k}")).groupBy(f"id{k}").agg(F.first(f"s{k}").alias(f"s{k}")).hint("merge")
    only = lambda s, k: s.join(pairs.select(F.col(f"id{k}").alias("id")).distinct().hint("merge"), "id", "left_semi")
    both = hot_join(pairs, pick(only(left, 1), 1), "id1", hubs["id1"], "id2")
    both = hot_join(both, pick(only(right, 2), 2), "id2", hubs["id2"], "id1")
    out = both.select("id1", "id2", F.size(F.array_intersect("s1", "s2")).alias("common"), F.size("s1").alias("size1"), F.size("s2").alias("size2"))
    return out.where(test(F.col("common"), F.col("size1"), F.col("size2")))


def _jaccard_at_least(threshold: float):
    return lambda c, a, b: c >= F.lit(threshold) * (a + b - c)


def _bucket_rows(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("rep").alias("id"), "size", *[f"c{k}" for k in range(WORDS)], F.explode("segments").alias("key"))


def similar_within(sets: DataFrame, threshold: float, work: Workspace, recall: float = RECALL, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets of Jaccard >= threshold, and the copies of sets.

    sets: id bigint, elems array<bigint>; an id may repeat with the same set.
    Null and empty sets have no partner.  Returns (links: id1 < id2 over the smallest
    ids of equal sets, common, size1, size2; copies: id, rep for sets held by two ids or more).
    """
    plan = Plan(threshold, sets.count(), recall)
    classes, copies = sketch_classes(sets, plan, work)
    found, n = work.write_counted(near_pairs(_bucket_rows(classes), plan.radius, threshold, cap=cap), F.lit(True))
    work.drop(classes)
    links = work.write(verified(found, sets, sets, _jaccard_at_least(threshold), n))
    work.drop(found)
    return links, copies


def similar_between(queries: DataFrame, sets: DataFrame, threshold: float, work: Workspace, recall: float = RECALL, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of a query set and a set of Jaccard >= threshold: (links, copies of queries, copies of sets).

    The queries' segments are probed with up to two flipped bits, if that pays (see Plan), so
    fewer segments of the larger side are needed; queries should be the smaller table.
    """
    plan = Plan(threshold, sets.count(), recall, max(queries.count(), 1))
    q_classes, q_copies = sketch_classes(queries, plan, work, probing=True)
    s_classes, s_copies = sketch_classes(sets, plan, work)
    rows = _bucket_rows(q_classes).withColumn("tag", F.lit(0).cast("bigint")).unionByName(_bucket_rows(s_classes).withColumn("tag", F.lit(1).cast("bigint")))
    found, n = work.write_counted(near_pairs(rows, plan.radius, threshold, "sides", cap), F.lit(True))
    work.drop(q_classes)
    work.drop(s_classes)
    links = work.write(verified(found, queries, sets, _jaccard_at_least(threshold), n))
    work.drop(found)
    return links, q_copies, s_copies


def class_counts(sets: DataFrame, copies: DataFrame, ends: DataFrame) -> DataFrame:
    """Per id of sets its class (the smallest id with the same set) and how many links the class has: id, class_id, links.

    ends: class_id, once for each link that ends there.
    """
    degree = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    rows = sets.select("id").distinct().join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    return rows.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _crowded(df: DataFrame, column: str) -> list:
    """The values of a column with more than HUB rows, at most the thousand largest."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB)
    return [r[0] for r in counts.orderBy(F.desc("n")).limit(1000).select(column).collect()]


def _copied(links: DataFrame, copies: DataFrame, column: str, other: str) -> DataFrame:
    """links once for each copy of the class in a column.

    Classes of many links have their links salted, classes of many copies their copies.
    """
    m = copies.select(F.col("rep").alias(column), F.col("id").alias("__id")).hint("merge")
    big = _crowded(copies, "rep")
    few = links.where(~F.col(column).isin(big)) if big else links
    out = hot_join(few, m, column, _crowded(few, column), other, "left")
    if big:
        out = out.unionByName(hot_join(m.where(F.col(column).isin(big)), links.where(F.col(column).isin(big)), column, big, "__id"))
    return out.withColumn(column, F.coalesce("__id", column)).select("id1", "id2")


def _copy_pairs(copies: DataFrame) -> DataFrame:
    """All pairs of ids of one set (id1 < id2).  A set of many ids is cut into blocks whose pairs go to different tasks."""
    blocks = copies.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("nb"))
    cut = salted_join(copies, blocks.hint("merge"), ["rep"], ["id"]).withColumn("blk", F.pmod(F.hash("id"), F.col("nb")))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("rep", "id", "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"))
    x, y = (cut.select("rep", "p", "q", F.col("id").alias(f"id{k}"), F.col("blk").alias(f"blk{k}")) for k in (1, 2))
    both = x.join(y.hint("merge"), ["rep", "p", "q"]).where((F.col("id1") < F.col("id2")) & ((F.col("p") == F.col("q")) | (F.col("blk1") != F.col("blk2"))))
    return both.select("id1", "id2")


def expand_within(links: DataFrame, copies: DataFrame) -> DataFrame:
    """Links between classes and their copies as pairs of ids (id1 < id2)."""
    one = _copied(_copied(links.select("id1", "id2"), copies, "id1", "id2"), copies, "id2", "id1")
    return one.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).unionByName(_copy_pairs(copies))


def expand_between(links: DataFrame, q_copies: DataFrame, s_copies: DataFrame) -> DataFrame:
    """Links between classes of two tables as pairs of ids."""
    return _copied(_copied(links.select("id1", "id2"), q_copies, "id1", "id2"), s_copies, "id2", "id1")
