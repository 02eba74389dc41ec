"""Sketches of integer sets, computed for whole Arrow batches with numpy.

Sets come as list columns; values compare modulo 2**32.  Nulls in a list and
repeated values are dropped, a null list is the empty set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

MASK32 = np.uint64(0xFFFFFFFF)
_STEP = 500_000  # numbers held at a time by the sketching loops


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low 32 bits of all list values in order, and the offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if values.null_count:
        keep = np.asarray(values.is_valid())
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        values = values.drop_null()
    return np.asarray(values).astype(np.int64).view(np.uint64) & MASK32, offsets


def ragged_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like ragged(), with the distinct values of each row in ascending order."""
    values, offsets = ragged(column)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    both = np.sort((row << np.uint64(32)) | values)
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    counts = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(offsets) - 1)
    return both & MASK32, np.concatenate(([0], np.cumsum(counts)))


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify a set: two sums of mixed values (0, 0 for the empty set)."""
    out = []
    for seed in (11, 12):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values, seed), dtype=np.uint64)))
        with np.errstate(over="ignore"):
            out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def one_bit_minhashes(values: np.ndarray, offsets: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """A 0/1 matrix rows x bits: of each of `bits` random orders, one bit of the row's smallest element.

    Two sets of Jaccard similarity J agree in a bit with probability (1 + J) / 2.
    Rows of empty sets are all 0.  The orders are those of 32-bit products, of which processors multiply eight at once.
    """
    n = len(offsets) - 1
    out = np.zeros((n, bits), dtype=np.uint8)
    full = np.flatnonzero(np.diff(offsets) > 0)
    half = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    factors = half(mix(np.arange(bits, dtype=np.uint64), seed)) | np.uint32(1)
    width = 32
    at = 0
    while at < len(full):
        room = offsets[full[at]] + max(_STEP // 5 // width, 1)
        stop = max(at + 1, int(np.searchsorted(offsets[full + 1], room, side="right")))
        rows = full[at:stop]
        x = half(mix(values[offsets[rows[0]] : offsets[rows[-1] + 1]], seed + 100))
        starts = offsets[rows] - offsets[rows[0]]
        for c in range(0, bits, width):
            with np.errstate(over="ignore"):
                least = np.minimum.reduceat(x[:, None] * factors[None, c : c + width], starts, axis=0)
            out[rows, c : c + width] = (mix(least.astype(np.uint64), 7) >> np.uint64(63)).astype(np.uint8)
        at = stop
    return out


def pack_words(bits: np.ndarray) -> np.ndarray:
    """Bits rows x 64k as k signed 64-bit words a row."""
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def super_minhash(values: np.ndarray, offsets: np.ndarray, m: int, seed: int = 3) -> np.ndarray:
    """SuperMinHash signatures: rows x m numbers that agree with probability J, with lower variance than MinHash.

    Every element draws a random permutation of the m slots and offers the value
    j + u_j (0 <= u_j < 1) to the slot at place j; a slot keeps the least offer.
    All elements of all rows take step j together.  A row stops early, as soon as
    each of its slots holds less than j + 1, which no later step can improve.
    Offers are integers, j in the bits from 53 up.  Rows of empty sets hold the greatest number.
    """
    n = len(offsets) - 1
    sig = np.full((n, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(offsets[full + 1], offsets[full[at]] + _STEP // 16, side="right")))
        rows = full[at:stop]
        x = values[offsets[rows[0]] : offsets[rows[-1] + 1]]
        owner = np.repeat(np.arange(len(rows)), np.diff(offsets)[rows])
        block = np.full((len(rows), m), np.iinfo(np.uint64).max, dtype=np.uint64)
        swaps: list[np.ndarray] = []
        for j in range(m):
            draw = mix(x, seed * 1000 + j)
            place = j + ((draw >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
            slot = place.copy()
            for i in range(j - 1, -1, -1):  # undo the swaps (i, swaps[i]) to see which slot lies at the place
                s = swaps[i]
                slot = np.where(slot == i, s, np.where(slot == s, i, slot))
            offer = (np.uint64(j) << np.uint64(53)) | (mix(draw, 5) >> np.uint64(11))
            np.minimum.at(block.reshape(-1), owner * m + slot, offer)
            swaps.append(place)
            going = block.max(axis=1) >= np.uint64(j + 1) << np.uint64(53)
            if not going.any():
                break
            keep = going[owner]
            if not keep.all():
                x, owner, swaps = x[keep], owner[keep], [s[keep] for s in swaps]
        sig[rows] = block
        at = stop
    return sig


def tail_radius(bits: int, p: float, recall: float) -> int:
    """The least r with P(Binomial(bits, p) <= r) >= recall."""
    total = 0.0
    for r in range(bits + 1):
        total += math.exp(math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1) + (r * math.log(p) if r else 0) + ((bits - r) * math.log1p(-p) if bits - r else 0)) if 0 < p < 1 else float(r >= bits * p)
        if total >= recall:
            return r
    return bits


def near_share(length: int, p: float, errors: int) -> float:
    """P(Binomial(length, p) <= errors)."""
    return sum(math.comb(length, i) * p**i * (1 - p) ** (length - i) for i in range(errors + 1))


def segments_needed(q: float, recall: float) -> int:
    """How many independent trials of chance q give at least one success with chance recall (below 1)."""
    if not 0 < recall < 1:
        raise ValueError("recall lies between 0 and 1; sketches cannot promise every pair")
    return 1 if q >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-q)))


def shared_bands_needed(values: int, rows: int, p: float, recall: float) -> int:
    """How many bands of `rows` values, each chosen at random among `values`, find a pair with chance recall.

    The pair agrees in a value with chance p.  As bands share values, the number of
    values that agree is taken first (binomial; SuperMinHash varies less), then the bands given it.
    """
    agree = np.arange(values + 1)
    logs = np.array([math.lgamma(values + 1) - math.lgamma(x + 1) - math.lgamma(values - x + 1) + x * math.log(p) + (values - x) * math.log1p(-p) for x in agree])
    chance, hit = np.exp(logs), np.ones(values + 1)
    for r in range(rows):
        hit *= np.maximum(agree - r, 0) / (values - r)
    bands = segments_needed(p**rows, recall)
    while (chance * (1 - (1 - hit) ** bands)).sum() < recall:
        bands += max(1, bands // 50)
    return bands
