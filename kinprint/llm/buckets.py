"""Pairs of rows within buckets, by Hamming distance of short codes.

Input rows are (key bigint, id bigint, size int, c0.. bigint [, label bigint | side int]).
Rows of a bucket are compared as numpy blocks in Python workers; only pairs
within the radius leave a worker.  Buckets above `cap` rows are cut into blocks
whose block pairs go to different tasks, so no task meets more than 2 * cap
rows of a bucket; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.operators.skew import salted_join

CAP = 20_000
WORDS = 3
_PAIRS = pa.schema([("id1", pa.int64()), ("id2", pa.int64())])
_BLOCK = 1_000_000


def split_large(rows: DataFrame, cap: int, neighbours: bool = False) -> DataFrame:
    """Add p, q, blk: the block pair a copy of the row is sent to, and the row's own block.

    neighbours: a block meets only itself, so no row is copied.
    """
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    if not large.take(1):
        return rows.select("*", *[F.lit(0).alias(c) for c in ("p", "q", "blk")])
    cut = salted_join(rows, large.select("key", F.ceil(F.col("n") / cap).cast("int").alias("nb")), ["key"], ["id"], "left")
    cut = cut.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.hash("id"), F.col("nb")))
    if neighbours:
        return cut.select(*rows.columns, F.col("blk").alias("p"), F.col("blk").alias("q"), "blk")
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    return cut.select(*rows.columns, F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts = np.concatenate(([0], cuts))
    return starts, np.concatenate((cuts, [len(keys)]))


class _Compare:
    def __init__(self, radius: int, ratio: float, kind: str):
        self.radius, self.ratio, self.kind = radius, ratio, kind

    def pick(self, t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the index pairs that may be matches, sifted test by test."""
        ok = t["id"][i] != t["id"][j]
        if self.kind == "sides":
            ok &= t["tag"][i] != t["tag"][j]
        elif self.kind == "labels":
            ok &= t["tag"][i] != t["tag"][j]
        split = t["p"][i] != t["q"][i]
        if split.any():
            ok &= ~split | (t["blk"][i] != t["blk"][j])
        i, j = i[ok], j[ok]
        a, b = t["size"][i], t["size"][j]
        ok = np.minimum(a, b) >= self.ratio * np.maximum(a, b)
        i, j = i[ok], j[ok]
        far = np.zeros(len(i), dtype=np.int64)
        for k in range(WORDS):
            c = t[f"c{k}"].view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
            far += np.bitwise_count(c[i] ^ c[j])
        ok = far <= self.radius
        return i[ok], j[ok]

    def bucket_pairs(self, t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of all buckets of a sorted table."""
        starts, ends = _runs(np.stack([t["key"], t["p"], t["q"]], axis=1))
        n = ends - starts
        if self.kind == "next":
            i = np.setdiff1d(np.arange(len(t["key"]) - 1), ends - 1, assume_unique=True)
            yield self.pick(t, i, i + 1)
            return
        # A row meets the rows after it up to its group's end; where tags must differ, those after its own tag's run.
        end = np.repeat(ends, n)
        first = np.arange(len(end)) + 1
        if self.kind in ("sides", "labels"):
            _, tag_ends = _runs(np.stack([t["key"], t["p"], t["q"], t["tag"]], axis=1))
            first = np.repeat(tag_ends, np.diff(np.concatenate(([0], tag_ends))))
        todo = np.maximum(end - first, 0)
        rows = np.flatnonzero(todo)
        upto = np.cumsum(todo[rows])
        at = 0
        while at < len(rows):
            base = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, base + _BLOCK, side="right")))
            r = rows[at:stop]
            i = np.repeat(r, todo[r])
            j = np.arange(len(i)) - np.repeat(np.cumsum(todo[r]) - todo[r], todo[r]) + np.repeat(first[r], todo[r])
            yield self.pick(t, i, j)
            at = stop

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            t = {c: table[c].to_numpy() for c in table.column_names}
            for i, j in self.bucket_pairs(t):
                if len(i):
                    a, b = t["id"][i], t["id"][j]
                    swap = (t["tag"][i] > t["tag"][j]) if self.kind == "sides" else (a > b)
                    pairs = np.unique(np.stack([np.where(swap, b, a), np.where(swap, a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIRS)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 50_000:
                continue
            table = pa.Table.from_batches(held)
            k = np.stack([table[c].to_numpy() for c in ("key", "p", "q")], axis=1)
            last = np.flatnonzero(np.any(k != k[-1], axis=1))
            if len(last):
                cut = int(last[-1]) + 1
                yield from done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))


def near_pairs(rows: DataFrame, radius: int, ratio: float, kind: str = "all", cap: int = CAP) -> DataFrame:
    """Distinct pairs (id1, id2) of rows that share a key and whose codes differ in at most `radius` bits.

    kind: 'all' pairs with id1 < id2; 'next' only neighbours in the order of a bucket or
    of a block of it (one link for each row); 'labels' pairs of different label only; 'sides'
    pairs of a row of tag 0 (id1) and one of tag 1 (id2).  Rows have a column tag
    for the last two.  ratio: the least smaller size over larger size.
    """
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(0).cast("bigint"))
    rows = rows.select("key", "id", "size", *[f"c{k}" for k in range(WORDS)], "tag")
    rows = split_large(rows, cap, kind == "next").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "tag", "id")
    return rows.mapInArrow(_Compare(radius, ratio, kind), "id1 bigint, id2 bigint").distinct()
