"""Long exact spans shared between records, by super-k-mer partitioning.

A window is a run of `window` consecutive values.  Its minimiser is the m-mer in
it of least hash, and the consecutive windows of a record that share a minimiser
travel as one packed string to the minimiser's bucket.  Equal windows have equal
minimisers, so each bucket sorts and counts its windows by itself, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprint.llm.sketches import mix, ragged
from kinprint.operators.skew import salted_join
from kinprint.session import Workspace

WINDOW, MMER = 32, 12
#: Windows a string holds at most, and windows a bucket may hold before it is cut by its windows' whole values.
STRING, LARGE = 1024, 500_000
_CHUNK = 250_000
_FACTOR = 0x9FB21C651E98DF25

_STRINGS = "key bigint, rid bigint, pos int, packed binary"
_STRING_SCHEMA = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("packed", pa.binary())])


def _rolling(x: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the `width` values from each place on (as many as fit)."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    y = mix(x, seed)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(_FACTOR) + y[k : k + n]
    return mix(h, seed + 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each place on."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... length[0] numbers, then those of the next, ..."""
    return np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)


class _Cut:
    """Super-k-mers of whole batches: where they start, how many windows they hold and their minimisers."""

    def __init__(self, window: int, mmer: int):
        self.window, self.mmer = window, mmer

    def __call__(self, values: np.ndarray, offsets: np.ndarray):
        w = self.window
        if len(values) < w:
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        least = _sliding_min(_rolling(values, self.mmer, 51), w - self.mmer + 1)
        n_windows = np.maximum(np.diff(offsets) - w + 1, 0)
        at = _spread(offsets[:-1], n_windows)
        row = np.repeat(np.arange(len(n_windows)), n_windows)
        if not len(at):
            return at, at, np.zeros(0, dtype=np.uint64), row
        key = least[at]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        run = np.cumsum(new) - 1
        within = np.arange(len(at)) - np.flatnonzero(new)[run]
        cut = np.flatnonzero(new | (within % STRING == 0))
        return at[cut], np.diff(np.concatenate((cut, [len(at)]))), key[cut], row[cut]


def _counter(window: int, mmer: int):
    cut = _Cut(window, mmer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            _, n, key, _ = cut(*ragged(batch.column(1)))
            order = np.argsort(key)
            key, n = key[order], n[order]
            if len(key):
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["key", "n"])

    return run


def _packer(window: int, mmer: int):
    cut = _Cut(window, mmer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            values, offsets = ragged(batch.column(1))
            start, n, key, row = cut(values, offsets)
            if not len(start):
                continue
            length = n + window - 1
            data = values.astype("<u4")[_spread(start, length)]
            ends = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            rid = np.asarray(batch.column(0))[row]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid), pa.array((start - offsets[row]).astype(np.int32)), packed], schema=_STRING_SCHEMA)

    return run


def _unpack(table: pa.Table, window: int):
    """Values, and per window its place in them, its string, rid and position."""
    packed = table["packed"].combine_chunks()
    if isinstance(packed, pa.ChunkedArray):
        packed = pa.concat_arrays(packed.chunks)
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    values = np.frombuffer(packed.buffers()[2], dtype="<u4")[ends[0] // 4 : ends[-1] // 4]
    start = (ends[:-1] - ends[0]) // 4
    n = np.diff(ends) // 4 - window + 1
    string = np.repeat(np.arange(len(n)), n)
    at = _spread(start, n)
    return values, at, string, table["rid"].to_numpy()[string], table["pos"].to_numpy()[string] + (at - start[string])


_SPAN_SCHEMA = pa.schema([("rid", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])


def _sorter(window: int):
    def spans(table: pa.Table) -> pa.RecordBatch:
        values, at, string, rid, pos = _unpack(table, window)
        h = _rolling(values, window, 61)[at]
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = np.flatnonzero(hs[1:] == hs[:-1])
        a, b = at[order[same]], at[order[same + 1]]
        equal = np.ones(len(same), dtype=bool)
        for k in range(window):  # the values decide, not the hash
            equal &= values[a + k] == values[b + k]
        new = np.ones(len(h), dtype=bool)
        new[same[equal] + 1] = False
        first = np.flatnonzero(new)
        r = rid[order]
        several = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
        shared = np.empty(len(h), dtype=bool)
        shared[order] = several[np.cumsum(new) - 1]
        before = np.concatenate(([False], shared[:-1] & (string[1:] == string[:-1])))
        after = np.concatenate((shared[1:] & (string[1:] == string[:-1]), [False]))
        i, j = np.flatnonzero(shared & ~before), np.flatnonzero(shared & ~after)
        return pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array(pos[i].astype(np.int32)), pa.array((pos[j] + window).astype(np.int32))], schema=_SPAN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += batch.column(3).nbytes // 16
            if weight < _CHUNK:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # rows come sorted by key
            if cut:
                yield spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                weight = sum(b.column(3).nbytes for b in held) // 16
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _exploder(window: int):
    """Every window of a string by itself, with its values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            values, at, _, rid, pos = _unpack(pa.Table.from_batches([batch]), window)
            data = np.lib.stride_tricks.sliding_window_view(values, window)[at]
            ends = np.arange(len(at) + 1, dtype=np.int32) * (4 * window)
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([packed, pa.array(rid), pa.array(pos.astype(np.int32))], names=["w", "rid", "pos"])

    return run


def shared_spans(records: DataFrame, work: Workspace, window: int = WINDOW, mmer: int = MMER, large: int = LARGE) -> DataFrame:
    """The longest stretches of positions covered by windows that also stand in another record: rid, start_pos, end_pos.

    records: (rid, seq array<bigint>), values modulo 2**32; a rid may repeat with
    the same sequence.  Nulls in a sequence are left out, null and short sequences
    share nothing.  Positions count from 0, end_pos is exclusive.

    Buckets of more than `large` windows are not gathered in one task: they are cut by
    all values of their windows, whose records are counted by a combining aggregate,
    so a window of a third of all records sends one row a task.  Both ways compare
    values and give the same rows.
    """
    records = records.where(F.col("rid").isNotNull())
    counts = records.mapInArrow(_counter(window, mmer), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    crowded = work.write(counts.where(F.col("n") > large).select("key", F.lit(1).alias("crowded")))
    strings = records.mapInArrow(_packer(window, mmer), _STRINGS)
    some = bool(crowded.take(1))
    if some:
        strings = salted_join(strings, crowded, ["key"], ["rid", "pos"], "left")
    calm = strings.where(F.col("crowded").isNull()).drop("crowded") if some else strings
    spans = calm.repartition("key").sortWithinPartitions("key").mapInArrow(_sorter(window), "rid bigint, start_pos int, end_pos int")
    if some:
        rows = strings.where(F.col("crowded").isNotNull()).select("key", "rid", "pos", "packed").mapInArrow(_exploder(window), "w binary, rid bigint, pos int")
        rows = work.write(rows)
        shared = rows.groupBy("w").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where(F.col("a") != F.col("b")).select("w")
        marked = salted_join(rows, shared, ["w"], ["rid", "pos"])
        spans = spans.unionByName(marked.select("rid", F.col("pos").alias("start_pos"), (F.col("pos") + window).alias("end_pos")))
    return merged_spans(spans)


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a record as one."""
    before = Window.partitionBy("rid").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    islands = spans.withColumn("__new", F.when(F.col("start_pos") <= F.max("end_pos").over(before), 0).otherwise(1))
    islands = islands.withColumn("__i", F.sum("__new").over(Window.partitionBy("rid").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("rid", "__i").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("__i")


def shared_shares(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Per record its length, its shared positions and their share (0 for an empty sequence)."""
    lengths = records.where(F.col("rid").isNotNull()).groupBy("rid").agg(F.max(F.size(F.filter(F.coalesce("seq", F.array().cast("array<bigint>")), lambda x: x.isNotNull()))).alias("n_values"))
    covered = spans.groupBy("rid").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"))
    out = lengths.join(covered, "rid", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return out.withColumn("share", F.when(F.col("n_values") > 0, F.col("n_shared") / F.col("n_values")).otherwise(0.0))
