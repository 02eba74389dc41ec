"""Common values of all pairs of sets within a scope, counted block by block in Arrow workers.

Counts of a pair never leave the task that holds both sets: what is shuffled are the sets,
once for each block pair they meet in, and not the meetings of their values, of which there are
far more.  Nothing is dropped; a value that all sets hold costs one row of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.operators.skew import salted_join

#: Sets, and values of them, of a scope that stay in one block at most; larger scopes are cut.
SETS, VALUES = 2_000, 1_000_000
#: Scopes to be cut that are told to all tasks at most; more are joined by shuffle.
FEW = 10_000
#: Meetings listed at once, and rows given out at once.
MEETINGS, ROWS = 2_000_000, 200_000
#: A value held by more than one in so many sets of a block is counted by a matrix product.
COMMON = 8


def _counts(values: np.ndarray, owner: np.ndarray, left: int, right: int) -> np.ndarray:
    """Common values of the sets 0 .. left-1 with the `right` sets after them; right = 0: of all sets with those after them (upper triangle)."""
    width = right or left
    base = left if right else 0
    if len(values) and (values.min() < 0 or values.max() >> 32):
        values = np.unique(values, return_inverse=True)[1]
    both = np.sort((values.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
    value, owner = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(value)]))
    n = ends - starts
    out = np.zeros(left * width, dtype=np.int64)

    often = n > max(64, (left + right) // COMMON)
    for at in range(0, int(often.sum()), 512):
        some = np.flatnonzero(often)[at : at + 512]
        held = np.zeros((len(some), left + right), dtype=np.float32)
        for k, s in enumerate(some):
            held[k, owner[starts[s] : ends[s]]] = 1
        out += (held[:, :left].T @ held[:, base:]).astype(np.int64).ravel()

    # An entry meets those after it in its value's run, of the other side where there are two.
    first = np.arange(1, len(value) + 1)
    if right:
        first = np.repeat(starts + np.add.reduceat(owner < left, starts), n) if len(value) else first
    todo = np.where(np.repeat(often, n) | (owner >= left), 0, np.repeat(ends, n) - first)
    rows = np.flatnonzero(todo)
    upto = np.cumsum(todo[rows])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, side="right")))
        r = rows[at:stop]
        t = todo[r]
        other = np.arange(int(t.sum())) + np.repeat(first[r] - (np.cumsum(t) - t), t)
        out += np.bincount(np.repeat(owner[r] * width - base, t) + owner[other], minlength=len(out))
        at = stop
    out = out.reshape(left, width)
    return out if right else np.triu(out, 1)


class _Blocks:
    """Rows sorted by scope and block pair to pairs, or to their numbers by similarity in hundredths."""

    def __init__(self, scope: list[str], types: list[pa.DataType], buckets: bool):
        self.scope, self.types, self.buckets = scope, types, buckets

    def rows(self, key: tuple, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        fixed = [pa.repeat(pa.scalar(v, kind), n) for v, kind in zip(key, self.types)]
        names = ["bucket", "n"] if self.buckets else ["rep1", "rep2", "common", "n1", "n2"]
        return pa.RecordBatch.from_arrays([*fixed, *map(pa.array, columns)], names=[*self.scope, *names])

    def done(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = tuple(table[c][0].as_py() for c in self.scope)
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        rep, blk = table["rep"].to_numpy(), table["blk"].to_numpy()
        fps = table["fps"].combine_chunks()
        size = np.diff(fps.offsets.to_numpy())
        order = np.lexsort((rep, blk))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        left = int((blk == p).sum())
        counts = _counts(fps.flatten().to_numpy(zero_copy_only=False), np.repeat(place, size), left, 0 if p == q else len(rep) - left)
        rep, size = rep[order], size[order].astype(np.int32)
        i, j = np.nonzero(counts)
        common = counts[i, j]
        if p != q:
            j = j + left
        for at in range(0, len(i), ROWS):
            a, b, c = i[at : at + ROWS], j[at : at + ROWS], common[at : at + ROWS]
            a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
            if self.buckets:
                sim = 2.0 * c / (size[a] + size[b])
                n = np.bincount(np.minimum(100, np.floor(sim * 100 + 0.5)).astype(np.int64), minlength=101)
                yield self.rows(key, np.flatnonzero(n).astype(np.int32), n[n > 0])
            elif len(a):
                yield self.rows(key, rep[a], rep[b], c, size[a], size[b])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [*self.scope, "p", "q"]
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in by:
                x = batch.column(batch.schema.get_field_index(c))
                change[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(change).tolist()]
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                key = tuple(part.column(part.schema.get_field_index(c))[0].as_py() for c in by)
                if held and key != now:
                    yield from self.done(pa.Table.from_batches(held))
                    held = []
                held.append(part)
                now = key
        if held:
            yield from self.done(pa.Table.from_batches(held))


def _blocked(groups: DataFrame, scope: list[str]) -> DataFrame:
    """Groups that can meet, a copy for each block pair (p, q) of their scope, with their own block blk."""
    known = groups.where(F.size("fps") > 0)
    for c in scope:
        known = known.where(F.col(c).isNotNull())
    nb = F.ceil(F.greatest(F.col("g") / SETS, F.col("v") / VALUES)).cast("int")
    large = known.groupBy(*scope).agg(F.count(F.lit(1)).alias("g"), F.sum(F.size("fps")).alias("v")).select(*scope, nb.alias("nb")).where(F.col("nb") > 1)
    rows = known.select(*scope, "rep", "fps")
    listed = large.take(FEW + 1)
    if not listed:
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("blk", "p", "q")])
    else:
        if len(listed) <= FEW:
            rows = rows.join(F.broadcast(groups.sparkSession.createDataFrame(listed, large.schema)), scope, "left")
        else:
            rows = salted_join(rows, large, scope, ["rep"], "left")
        rows = rows.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(*scope, "rep", "fps", "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"))
    return rows.repartition(*scope, "p", "q").sortWithinPartitions(*scope, "p", "q")


def _run(groups: DataFrame, scope: list[str], buckets: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [groups.schema[c] for c in scope]
    what = "bucket int, n bigint" if buckets else "rep1 bigint, rep2 bigint, common bigint, n1 int, n2 int"
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), what])
    return _blocked(groups, scope).mapInArrow(_Blocks(scope, [to_arrow_type(f.dataType) for f in fields], buckets), ddl)


def common_counts(groups: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of groups (scope, rep, fps) of a scope with a common value: rep1 < rep2, common, and the sizes n1, n2."""
    return _run(groups, scope, False)


def common_buckets(groups: DataFrame, scope: list[str]) -> DataFrame:
    """Numbers of those pairs by similarity in hundredths (scope, bucket, n), in part sums; no pair leaves its worker."""
    return _run(groups, scope, True)
