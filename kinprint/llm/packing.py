"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.sources.tables import settings_rows

#: Items of one shard: a bound on the memory and time of a packing task.
SHARD = 8_000
#: Kinds of items looked at together.
CHUNK = 256
#: Capacities at most; more are refused.
MOST_SPECS = 1000
#: Limits where the settings name none: of a container's tokens so many may bear loss, and it may hold a segment for each so many tokens.
LOSS_SHARE, TOKENS_A_SEGMENT = 0.95, 16


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item.

    sizes: items x dimensions, limits: dimensions.  The open container takes, of
    the items that fit it in every dimension, the one with the greatest dot
    product of its size and the room left, both as shares of the limits; with none
    left that fits it is closed.  An item over a limit has a container of its own.

    Equal items are handled as one kind.  Kinds lie in order of their first dimension
    and are looked through downwards, CHUNK at a time, from the largest before which any can
    fit, until the greatest shares of all smaller kinds bound their products below the best found.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    alone = np.flatnonzero((sizes > limits).any(axis=1))
    out[alone] = np.arange(len(alone))
    rest = np.setdiff1d(np.arange(len(sizes)), alone, assume_unique=True)
    if not len(rest):
        return out
    kinds, kind = np.unique(sizes[rest], axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    order = rest[np.argsort(kind, kind="stable")]
    left = np.bincount(kind, minlength=len(kinds))
    at = np.concatenate(([0], np.cumsum(left)))[:-1]
    container, total = len(alone), len(rest)
    gone = len(kinds)  # kinds used up since the arrays below were made
    while total:
        if gone * 4 > len(kinds) or container == len(alone):
            kept = left > 0
            kinds, left, at, gone = kinds[kept], left[kept], at[kept], 0
            share = kinds / limits
            greatest = np.maximum.accumulate(share, axis=0)
            # The least size of a kind and all after it, by dimension: where it is above the room, none of them fits.
            least = np.minimum.accumulate(kinds[::-1], axis=0)[::-1].T.tolist()
            sizes_of = [np.ascontiguousarray(c) for c in kinds.T]
            used = np.zeros(len(kinds), dtype=bool)
        room = limits.tolist()
        while True:
            weight = np.array(room) / limits
            top, best, product = min(map(bisect_right, least, room)), -1, -1.0
            while top > 0 and (best < 0 or greatest[top - 1] @ weight > product):
                low = max(0, top - CHUNK)
                products = share[low:top] @ weight
                products[used[low:top]] = -1
                for size, left_over in zip(sizes_of, room):
                    products[size[low:top] > left_over] = -1
                i = int(products.argmax())
                if products[i] > product:
                    best, product = low + i, products[i]
                top = low
            if best < 0:
                break
            out[order[at[best]]] = container
            at[best] += 1
            left[best] -= 1
            if not left[best]:
                used[best] = True
                gone += 1
            total -= 1
            room = [r - int(size[best]) for r, size in zip(room, sizes_of)]
        container += 1
    return out


def with_limits(specs: DataFrame, loss_share: float = LOSS_SHARE, tokens_a_segment: int = TOKENS_A_SEGMENT) -> DataFrame:
    """The settings in use, one row a spec_id: capacity_tokens, max_segments, max_loss_tokens.

    specs: spec_id, capacity_tokens and, if it has them, max_segments and max_loss_tokens.  Where these
    are missing or null, they come from loss_share and tokens_a_segment, which are choices of this
    library and not of the data.  Null and non-positive capacities are left out; of repeated ids the greatest values count.
    """
    given = lambda c: F.col(c) if c in specs.columns else F.lit(None)
    rows = specs.where(F.col("spec_id").isNotNull() & (F.col("capacity_tokens") > 0)).select(
        F.col("spec_id").cast("bigint").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity_tokens"),
        F.greatest(F.lit(1), F.coalesce(given("max_segments"), F.floor(F.col("capacity_tokens") / tokens_a_segment))).cast("int").alias("max_segments"),
        F.greatest(F.lit(1), F.coalesce(given("max_loss_tokens"), F.floor(F.col("capacity_tokens") * loss_share))).cast("int").alias("max_loss_tokens"),
    )
    top = rows.groupBy("spec_id").agg(F.max(F.struct("capacity_tokens", "max_segments", "max_loss_tokens")).alias("s"))
    return top.select("spec_id", "s.*")


def pieces(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Every text as items for each capacity: cut into full pieces and a rest only if it is longer than the capacity.

    counts: doc_id, n_tokens, n_prompt.  limits: as with_limits gives them (a settings
    table).  Texts without tokens have no item.
    """
    # Each text is repeated for each setting, which is what is asked for; nothing is compared.
    known = settings_rows(limits.orderBy("spec_id"), MOST_SPECS, "pack_specs")
    option = "array<struct<spec_id:bigint,capacity:int,max_segments:int,max_loss_tokens:int>>"
    options = F.array(*[F.struct(*[F.lit(v) for v in r]) for r in known]).cast(option)
    rows = counts.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", "n_prompt", F.explode(options).alias("s")).select("doc_id", "n_tokens", "n_prompt", "s.*")
    rows = rows.withColumn("piece", F.explode(F.expr("sequence(0, cast((n_tokens - 1) div capacity as int))")))
    rows = rows.withColumn("start_token", F.col("piece") * F.col("capacity"))
    end = F.least(F.col("start_token") + F.col("capacity"), F.col("n_tokens"))
    loss = F.greatest(end - F.greatest("start_token", "n_prompt"), F.lit(0))
    return rows.select("spec_id", "capacity", "max_segments", "max_loss_tokens", "doc_id", "piece", "start_token", (end - F.col("start_token")).alias("n_tokens"), loss.cast("int").alias("n_loss"))


_PACKED = "spec_id bigint, container_id bigint, doc_id bigint, piece int, start_token int, n_tokens int, n_loss int"


def _pack_shard(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
    frames = frames.sort_values(["n_tokens", "n_loss", "doc_id", "piece"], kind="stable")
    limits = frames[["capacity", "max_segments", "max_loss_tokens"]].iloc[0].to_numpy(dtype=np.int64)
    sizes = np.stack([frames["n_tokens"], np.ones(len(frames)), frames["n_loss"]], axis=1).astype(np.int64)
    frames["container_id"] = (int(key[1]) << 32) | pack(sizes, limits)
    return frames[["spec_id", "container_id", "doc_id", "piece", "start_token", "n_tokens", "n_loss"]]


def packed(counts: DataFrame, specs: DataFrame, shard: int = SHARD, loss_share: float = LOSS_SHARE, tokens_a_segment: int = TOKENS_A_SEGMENT) -> DataFrame:
    """Items and their containers: spec_id, container_id, doc_id, piece, start_token, n_tokens, n_loss.

    A container keeps three limits at once (see with_limits): tokens, items, and loss-bearing
    tokens (those after a text's first line; a text of one line bears loss throughout).  An item that alone is over
    a limit stands alone.  Items are spread over shards of about `shard` items by
    hash and every shard is packed by itself, which costs at most one half-empty
    container a shard.  A repeated doc_id is an item as often as it stands there.
    """
    items = pieces(counts, with_limits(specs, loss_share, tokens_a_segment))
    n = counts.count()
    shards = max(1, math.ceil(n / shard))
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return keyed.groupBy("spec_id", "shard").applyInPandas(_pack_shard, _PACKED)


def container_report(items: DataFrame, specs: DataFrame, loss_share: float = LOSS_SHARE, tokens_a_segment: int = TOKENS_A_SEGMENT) -> DataFrame:
    """Per setting its limits, containers, items, tokens and the share of room used (the last partial containers included)."""
    per = items.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    per = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    used = (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used_share")
    return per.join(with_limits(specs, loss_share, tokens_a_segment), "spec_id").select("spec_id", "capacity_tokens", "max_segments", "max_loss_tokens", "containers", "items", "tokens", "fullest", used)


def packing_faults(items: DataFrame, counts: DataFrame, specs: DataFrame) -> DataFrame:
    """Per setting the texts packed, and how many texts or containers break a rule; all but texts are 0 for a sound packing.

    counts: doc_id (unique), n_tokens.  wrong_tokens: texts whose pieces do not hold each token
    once; needless_splits: texts within the capacity in several pieces; over_capacity: containers
    above the capacity; over_limits: containers of several items above another limit.
    """
    limits = with_limits(specs)
    texts = items.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"))
    whole = texts.join(counts.select("doc_id", F.col("n_tokens").alias("all")), "doc_id").join(limits, "spec_id")
    per_text = whole.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("t") != F.col("all")) | (F.col("end") != F.col("all")) | (F.col("starts") != F.col("n"))).alias("wrong_tokens"),
        F.count_if((F.col("all") <= F.col("capacity_tokens")) & (F.col("n") > 1)).alias("needless_splits"),
    )
    full = items.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("n_loss").alias("loss")).join(limits, "spec_id")
    broken = (F.col("n") > 1) & ((F.col("n") > F.col("max_segments")) | (F.col("loss") > F.col("max_loss_tokens")))
    per_container = full.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_capacity"), F.count_if(broken).alias("over_limits"))
    return per_text.join(per_container, "spec_id").select("spec_id", "texts", "wrong_tokens", "needless_splits", "over_capacity", "over_limits")
