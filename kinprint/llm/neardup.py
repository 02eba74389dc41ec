"""Groups of near copies: SuperMinHash signatures, banding, verification, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.llm.buckets import CAP, WORDS, near_pairs
from kinprint.llm.components import connected_components
from kinprint.llm.setjoin import verified
from kinprint.llm.sketches import digests, mix, one_bit_minhashes, pack_words, ragged_sets, segments_needed, shared_bands_needed, super_minhash, tail_radius
from kinprint.operators.skew import salted_join
from kinprint.session import Workspace, spread

RECALL = 0.998
#: Values of a signature at most.
VALUES = 256

_SIGNED = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int32()), *[(f"c{k}", pa.int64()) for k in range(WORDS)], ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "id bigint, d1 bigint, d2 bigint, size int, " + ", ".join(f"c{k} bigint" for k in range(WORDS)) + ", bands array<bigint>"


class Banding:
    """Values a signature, and the values of each band, for a table of n rows.

    Each value of a band cuts a bucket of unlike rows to about 1/16, so bands have log16(n)
    values and buckets keep their size.  Bands have values of their own while a signature
    is no longer than VALUES; beyond that each is a seeded choice among VALUES, and there are more of them.
    """

    def __init__(self, n: int, jaccard: float, recall: float, rows: int | None = None):
        self.rows = rows or min(8, max(4, math.ceil(math.log(max(n, 2), 16))))
        bands = segments_needed(jaccard**self.rows, recall)
        if bands * self.rows <= VALUES:
            self.values, self.chosen = bands * self.rows, np.arange(bands * self.rows).reshape(bands, self.rows)
        else:
            self.values = VALUES
            draw = np.random.default_rng(17)
            self.chosen = np.stack([draw.choice(VALUES, self.rows, replace=False) for _ in range(shared_bands_needed(VALUES, self.rows, jaccard, recall))])


def _signer(banding: Banding):
    chosen = banding.chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            values, offsets = ragged_sets(batch.column(1))
            sig = super_minhash(values, offsets, banding.values)
            keys = np.broadcast_to(np.arange(len(chosen), dtype=np.uint64), (len(sig), len(chosen)))
            for r in range(chosen.shape[1]):
                keys = mix(keys ^ sig[:, chosen[:, r]], 31 + r)
            words = pack_words(one_bit_minhashes(values, offsets, 64 * WORDS, seed=41))
            a, b = digests(values, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * len(chosen)), pa.array(np.ascontiguousarray(keys).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(np.diff(offsets).astype(np.int32)), *[pa.array(words[:, k]) for k in range(WORDS)], lists], schema=_SIGNED)

    return run


def near_copy_groups(sets: DataFrame, dice: float, work: Workspace, recall: float = RECALL, rows: int | None = None, cap: int = CAP) -> DataFrame:
    """Group ids whose sets have 2*common/(size+size) >= dice, and near copies of near copies: (rid, group_id).

    sets: id bigint, elems array<bigint> (an id may repeat with the same set).  Only
    groups of two ids or more are listed; group_id is the group's smallest id.
    Null and empty sets are in no group.

    Equal sets are merged first.  Then two rounds of candidates from the same
    bands: first each row with its neighbour in the bucket, whose verified links
    give labels; then only pairs of rows that still have different labels.  A
    bucket full of near copies thus sends a few links a row, not all its pairs,
    while every candidate pair between groups is still verified.  Verified links go
    through union-find per partition and then as components (connected_components).
    """
    jaccard = dice / (2 - dice)
    radius = tail_radius(64 * WORDS, (1 - jaccard) / 2, 1 - (1 - recall) / 4)
    key = ["d1", "d2", "size"]
    codes = [f"c{k}" for k in range(WORDS)]
    signed = work.write(spread(sets.select("id", "elems")).mapInArrow(_signer(Banding(sets.count(), jaccard, recall, rows)), _SIGNED_DDL).where(F.col("size") > 0))
    classes = work.write(signed.groupBy(*key).agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in [*codes, "bands"]]).select("rep", "size", *codes, "bands"))
    shared = signed.groupBy(*key).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")).where(F.col("n") > 1).select(*key, "rep")
    copies = work.write(salted_join(signed.select("id", *key), shared.hint("merge"), key, ["id"]).where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    work.drop(signed)
    test = lambda c, a, b: 2 * c >= F.lit(dice) * (a + b)

    def links(tagged: DataFrame, kind: str) -> DataFrame:
        buckets = tagged.select(F.col("rep").alias("id"), "size", *codes, *(["tag"] if "tag" in tagged.columns else []), F.explode("bands").alias("key"))
        found, n = work.write_counted(near_pairs(buckets, radius, jaccard, kind, cap), F.lit(True))
        return verified(found, sets, sets, test, n).select(F.col("id1").alias("a"), F.col("id2").alias("b"))

    labels = work.write(connected_components(links(classes, "next"), work))
    tagged = work.write(classes.join(labels.hint("merge"), classes["rep"] == labels["v"], "left").select("rep", "size", *codes, "bands", F.coalesce("p", "rep").alias("tag")))
    work.drop(classes)
    stars = labels.where(F.col("v") != F.col("p")).select(F.col("v").alias("a"), F.col("p").alias("b"))
    return connected_components(stars.unionByName(links(tagged, "labels")).unionByName(copies), work).select(F.col("v").alias("rid"), F.col("p").alias("group_id"))
