"""Mixing sources to target shares by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprint.session import Workspace
from kinprint.sources.tables import settings_rows

BLOCK = 64
#: Texts of a (source, shard) at most, about: the bound on a window's rows.
SHARD = 20_000
#: Sources of the settings at most; more are refused.
MOST_SOURCES = 100_000


def sainte_lague(weights: dict[str, float], seats: int, caps: dict[str, int] | None = None) -> dict[str, int]:
    """Seats by highest quotients weight / (2 * seats held + 1); of equal quotients the first name.

    A source at its cap gets no further seat; seats that no source can take stay empty.
    The start is a divisor under which nobody has more than the highest quotients give,
    so the loop runs only over the last few seats.
    """
    caps = caps or {}
    names = sorted(n for n, w in weights.items() if w > 0)
    total = sum(weights[n] for n in names)
    held = {n: 0 for n in weights}
    if not names or seats <= 0:
        return held
    scale = max(0.0, seats - len(names)) / total
    for n in names:
        held[n] = min(int(math.floor(weights[n] * scale)), caps.get(n, seats))
    queue = [(-weights[n] / (2 * held[n] + 1), n) for n in names if held[n] < caps.get(n, seats)]
    heapq.heapify(queue)
    free = seats - sum(held.values())
    while free > 0 and queue:
        # Far from the end, when capped sources leave much to the others, seats go out in strides.
        stride = free // (4 * len(queue)) if free > 64 * len(queue) else 0
        if stride:
            share = sum(weights[n] for _, n in queue)
            for _, n in queue:
                more = min(int(free * weights[n] / share * 0.5), caps.get(n, seats) - held[n])
                held[n] += more
            queue = [(-weights[n] / (2 * held[n] + 1), n) for _, n in queue if held[n] < caps.get(n, seats)]
            heapq.heapify(queue)
            free = seats - sum(held.values())
            continue
        _, n = heapq.heappop(queue)
        held[n] += 1
        free -= 1
        if held[n] < caps.get(n, seats):
            heapq.heappush(queue, (-weights[n] / (2 * held[n] + 1), n))
    return held


def clean_source(column: str = "source"):
    """A source's name without case and padding; blank names are null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", "")), F.lit(""))


#: As a total: the tokens that all sources with a target hold together.
ALL = -1


def quotas(available: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK) -> list[dict]:
    """Per source of the settings: share, tokens available, cap, tokens wanted and quota in whole blocks.

    available: source, tokens (one row a source).  targets: source, target_share,
    max_repeats.  Sources missing on either side get nothing.  Without total_tokens
    the mixture is the largest in which every source present reaches its share
    within its repeats; with it (or ALL), sources at their cap leave their rest to the others.
    """
    wanted = targets.where(F.col("target_share") > 0).groupBy(clean_source().alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in settings_rows(wanted.where(F.col("source").isNotNull()).join(available, "source", "left").orderBy("source"), MOST_SOURCES, "mix_targets")]
    for r in rows:
        r["tokens"] = int(r["tokens"] or 0)
        r["most"] = r["tokens"] * max(1, r["max_repeats"] or 1)
    there = [r for r in rows if r["tokens"] > 0]
    mass = sum(r["target_share"] for r in there)
    if total_tokens is None:
        total_tokens = int(min((r["most"] / (r["target_share"] / mass) for r in there), default=0))
    elif total_tokens == ALL:
        total_tokens = sum(r["tokens"] for r in there)
    everything = sum(r["target_share"] for r in rows)
    held = sainte_lague({r["source"]: r["target_share"] for r in there}, total_tokens // block, {r["source"]: r["most"] // block for r in there})
    for r in rows:
        r["quota"] = held.get(r["source"], 0) * block
        r["wanted"] = int(round(total_tokens * r["target_share"] / everything))
    return rows


_BLOCKS = "source string, shard int, held bigint, cap int, blocks bigint"


def _shard_blocks(block: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(frame["shard"].tolist(), frame["held"].tolist()))
        cap = int(frame["cap"].iloc[0])
        got = sainte_lague(held, int(frame["quota"].iloc[0]) // block, {h: -(-n * cap // block) for h, n in held.items()})
        return frame.assign(blocks=[got[h] for h in frame["shard"].tolist()])[["source", "shard", "held", "cap", "blocks"]]

    return run


def shard_blocks(stock: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """A source's quota of whole blocks dealt to its shards by highest quotients of their tokens: source, shard, held, cap, blocks.

    stock: source, shard, held (one row a shard, so a source's rows fit one task).
    plan: source, quota, cap.  A shard's texts, laid in a line cap times over, make
    ceil(held * cap / block) blocks, so every block of the quota finds a shard.
    """
    return stock.join(plan.select("source", "quota", "cap"), "source").groupBy("source").applyInPandas(_shard_blocks(block), _BLOCKS)


def mixture(counts: DataFrame, targets: DataFrame, work: Workspace, total_tokens: int | None = None, block: int = BLOCK, seed: int = 1, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, source, n_tokens, copies; report: the tokens and shares wanted and reached per source).

    total_tokens: the size aimed at (ALL: what the sources hold together).  A source whose
    repeats do not suffice for its share has the rest as shortfall_tokens in the report, and others fill the room.

    counts: doc_id, source, n_tokens.  Texts of no tokens, of no source or of a source
    without a target are left out.  A source's quota is dealt to its shards in whole
    blocks (shard_blocks).  In a shard the texts are laid on a line in a seeded order,
    max_repeats times over, and the line is cut into numbered blocks of `block`
    tokens, the last one shorter; a copy of a text goes with the block that holds its
    middle token.  Blocks are taken by number up to the quota: as the order of the
    texts is random, the first blocks are a random choice, and at one edge only can a
    text reach over them.  So no text is taken more than max_repeats times, and none
    is cut.
    """
    texts = counts.where(F.col("n_tokens") > 0).select("doc_id", clean_source().alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where(F.col("source").isNotNull())
    shards = max(1, math.ceil(counts.count() / shard))
    texts = work.write(texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int")))
    stock = work.write(texts.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held")))
    rows = quotas(stock.groupBy("source").agg(F.sum("held").alias("tokens")), targets, total_tokens, block)
    spark = counts.sparkSession
    ddl = "source string, target_share double, max_repeats int, tokens bigint, wanted bigint, quota bigint"
    plan = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["tokens"], r["wanted"], r["quota"]) for r in rows], ddl)
    per_shard = shard_blocks(stock, plan.withColumn("cap", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))), block)
    per_shard = per_shard.select(F.col("source").alias("s"), F.col("shard").alias("h"), "held", "cap", (F.col("blocks") * block).alias("upto"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = texts.withColumn("end", F.sum("n_tokens").over(line))
    laid = laid.join(per_shard, (F.col("source") == F.col("s")) & (F.col("shard") == F.col("h")))
    # Copy j (from 0) has its middle at j * held + end - n_tokens / 2, and those before the end of the last block are taken.
    before = F.expr("(2 * upto - (2 * end - n_tokens) + 2 * held - 1) div (2 * held)")
    taken = laid.withColumn("copies", F.least(before, F.col("cap")).cast("int")).where(F.col("copies") > 0)
    taken = work.write(taken.select("doc_id", "source", "n_tokens", "copies"))
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    report = plan.join(got, "source", "left").withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0)))
    whole = got.agg(F.sum("taken_tokens")).first()[0] or 1
    report = report.select("source", "target_share", "max_repeats", F.col("tokens").alias("available_tokens"), F.col("wanted").alias("wanted_tokens"), F.col("quota").alias("quota_tokens"), "taken_tokens", F.greatest(F.col("wanted") - F.col("taken_tokens"), F.lit(0)).alias("shortfall_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.col("taken_tokens") / F.lit(float(whole))).alias("reached_share"))
    return taken, report


def mixture_faults(taken: DataFrame, report: DataFrame, counts: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per source of the settings its texts, and how many break a rule; all but texts_available are 0 for a sound mixture.

    over_repeats: texts taken more often than allowed; twice: texts in several rows; off_quota: 1
    if the tokens taken differ from the quota by more than a text and a block for each shard.
    """
    texts = counts.where(F.col("n_tokens") > 0).groupBy(clean_source().alias("source")).agg(F.count(F.lit(1)).alias("texts_available"), F.max("n_tokens").alias("longest"))
    caps = report.select("source", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("cap"))
    per = taken.join(caps, "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("cap")).alias("over_repeats"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("twice"))
    shards = max(1, math.ceil(counts.count() / shard))
    off = F.abs(F.col("taken_tokens") - F.col("quota_tokens")) > (F.coalesce("longest", F.lit(0)) + block) * shards
    zero = F.lit(0).cast("bigint")
    out = report.join(texts, "source", "left").join(per, "source", "left")
    return out.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("texts_available", "over_repeats", "twice")], off.cast("bigint").alias("off_quota"))
