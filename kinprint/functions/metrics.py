"""Evidence metrics of a pair as Column builders, and the two Arrow functions that need an algorithm."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprint.functions.lexer import BLANK

# --- fixed values: names that say nothing about who wrote a program ---
COMMON_NAMES = """i j k l m n a b c d e f g h p q r s t u v w x y z ok ans tmp temp sum res cnt tot num pos len size st ed
end begin vis dis dist dep fa son nxt pre flag flg head tail que stack str s1 s2 ch str1 str2 maxn maxx minn arr vec set map
mp lst li row col dx dy now ret val key it id ii jj kk nn mm tt pp xx yy zz""".split()
LEX_GATE, VAR_GATE, VAR_GATE_TRIVIAL = 0.85, 0.6, 0.8
# --- end of fixed values ---

CELL_LIMIT = 4_000_000
_DIFF = T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("type", T.StringType())]))


@dataclass(frozen=True)
class Thresholds:
    identical: float = 0.95
    high: float = 0.75
    suspected: float = 0.55


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def dice_or_null(a: Column, b: Column) -> Column:
    """Like dice, but null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def telling_names(idents: Column) -> Column:
    """Identifiers longer than two that are not among the common ones."""
    return F.array_distinct(F.filter(F.coalesce(idents, F.array().cast("array<string>")), lambda x: (F.length(x) > 2) & ~x.isin([n for n in COMMON_NAMES if len(n) > 2])))


def var_similarity(a: Column, b: Column) -> Column:
    return dice_or_null(telling_names(a), telling_names(b))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def func_similarity(a: Column, b: Column) -> Column:
    """Twice the matched body length over all body length; a body hash counts once.

    Of several bodies of one hash the shortest of a and the first of b count.
    Null if both have no function, 0 if one has none.
    """
    lengths = lambda fs: F.transform(fs, lambda f: f["len"].cast("bigint"))
    of = lambda fs, h: lengths(F.filter(fs, lambda f: f["hash"] == h))
    both = F.array_intersect(F.transform(b, lambda f: f["hash"]), F.transform(a, lambda f: f["hash"]))
    matched = _total(F.transform(both, lambda h: F.least(F.array_min(of(a, h)), F.get(of(b, h), F.lit(0)))))
    whole = _total(lengths(a)) + _total(lengths(b))
    return F.when(whole > 0, 2.0 * matched / whole)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the places both have; null if they are empty or a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.slice(x, F.lit(1), F.greatest(n, F.lit(0)))
    dot = lambda x, y: F.aggregate(F.zip_with(cut(x), cut(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) * dot(b, b)
    return F.when((n > 0) & (norm > 0), dot(a, b) / F.sqrt(norm))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from term to weight; null if either is empty or has no weight."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(F.transform(keys, lambda k: F.element_at(a, k) * F.element_at(b, k)), F.lit(0.0), lambda s, v: s + v)
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v)
    norm = square(a) * square(b)
    return F.when(norm > 0, dot / F.sqrt(norm))


def shared_count(a: Column, b: Column) -> Column:
    """Number of values both arrays have."""
    empty = F.array().cast("array<bigint>")
    return F.size(F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty)))


def classify(sim: Column, t: Thresholds = Thresholds()) -> Column:
    """Level 0 to 3 on one channel."""
    return F.when(sim >= t.identical, 3).when(sim >= t.high, 2).when(sim >= t.suspected, 1).otherwise(0)


def classify_pair(struct: Column, lexical: Column, names: Column, trivial: Column, t: Thresholds = Thresholds()) -> Column:
    """Level of a pair: structure with name evidence for the top level, or the lexical channel in saturated problems."""
    named = F.coalesce(lexical >= LEX_GATE, F.lit(False)) | F.coalesce(names >= VAR_GATE, F.lit(False))
    by_structure = F.when(struct >= t.identical, F.when(named, 3).otherwise(2)).when(struct >= t.high, 2).when(struct >= t.suspected, 1).otherwise(0)
    s = F.coalesce(lexical, struct)
    by_names = F.when((s >= t.identical) & F.coalesce(names >= VAR_GATE_TRIVIAL, F.lit(True)), 3).when(s >= t.high, 2).when(s >= t.suspected, 1).otherwise(0)
    return F.when(trivial, by_names).otherwise(by_structure)


LEVEL_LABELS = ("none", "suspected", "high", "identical")


def level_label(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVEL_LABELS)), level.cast("int") + 1)


def percent(x: Column) -> Column:
    """One decimal of a percentage, rounded half up; null stays null."""
    return F.floor(x * 1000 + 0.5) / 10


def heat(x: Column) -> Column:
    return F.when(x.isNull(), "na").when(x >= 0.7, "high").when(x >= 0.4, "mid").otherwise("low")


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def seq_similarity_of(a, b, limit: int = CELL_LIMIT) -> float | None:
    """2 * LCS / (n + m); null if a side is null or empty or n * m is above the limit."""
    if a is None or b is None or not len(a) or not len(b) or len(a) * len(b) > limit:
        return None
    return 2 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def seq_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Order-sensitive similarity of two token sequences."""
    return pd.Series([seq_similarity_of(x, y) for x, y in zip(a, b)], dtype="object")


def line_diff_of(a: list[str], b: list[str], limit: int = CELL_LIMIT) -> list[dict] | None:
    """Line diff of two texts' lines, blind to blanks at line ends; null above the limit.

    Rows keep a longest common subsequence; where lines differ a deletion comes
    first if it loses nothing.
    """
    if len(a) * len(b) > limit:
        return None
    x, y = [s.strip(BLANK) for s in a], [s.strip(BLANK) for s in b]
    n, m = len(x), len(y)
    head = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(n, m))
    number: dict[str, int] = {}
    p, q = (np.array([number.setdefault(s, len(number)) for s in lines[head:]], dtype=np.int32) for lines in (x, y))
    best = np.zeros((n - head + 1, m - head + 1), dtype=np.int32)
    for k in range(n - head - 1, -1, -1):
        below = best[k + 1]
        best[k, :-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(q == p[k], below[1:] + 1, 0))[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            i, j = i + 1, j + 1
            out.append({"l": i, "r": j, "type": "eq"})
        elif j >= m or (i < n and best[i + 1 - head, j - head] >= best[i - head, j + 1 - head]):
            i += 1
            out.append({"l": i, "r": None, "type": "del"})
        else:
            j += 1
            out.append({"l": None, "r": j, "type": "ins"})
    return out


@F.pandas_udf(_DIFF)
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Diff rows of two arrays of lines."""
    return pd.Series([None if x is None or y is None else line_diff_of(list(x), list(y)) for x, y in zip(a, b)])
