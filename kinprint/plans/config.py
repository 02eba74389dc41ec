"""Settings from loose values: defaults, floors, thresholds, lists of problems, user references."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.functions.metrics import Thresholds
from kinprint.plans.scan import ScanConfig


def number(value, default: float, least: float | None = None) -> float:
    """A number; blank, zero and unreadable values give the default, small ones the floor."""
    try:
        n = float(value) if str(value).strip() else 0.0
    except (TypeError, ValueError):
        n = 0.0
    n = default if not n or math.isnan(n) else n
    return n if least is None else max(least, n)


def thresholds(identical=None, high=None, suspected=None, default: Thresholds = Thresholds()) -> Thresholds:
    """Thresholds at four decimals in rising order; values out of (0.05, 1] give the default."""

    def one(value, fallback: float) -> float:
        try:
            x = float(value)
        except (TypeError, ValueError):
            return fallback
        return math.floor(x * 10000 + 0.5) / 10000 if 0.05 < x <= 1 else fallback

    low = one(suspected, default.suspected)
    mid = max(low, one(high, default.high))
    return Thresholds(max(mid, one(identical, default.identical)), mid, low)


def excluded_pids(text: str | None) -> tuple[int, ...]:
    """Positive whole numbers split at commas, full-width commas, semicolons and blanks, sorted, each once."""
    parts = re.split(r"[,，;\s]+", text or "")
    return tuple(sorted({int(p) for p in parts if re.fullmatch(r"\d+", p) and int(p) > 0}))


def scan_config(values: Mapping) -> ScanConfig:
    """A ScanConfig from a mapping of setting names."""
    get = values.get
    return ScanConfig(
        k=int(number(get("k"), 8, 2)),
        min_tokens=int(max(0, number(get("min_tokens"), 0, 0))),
        max_code_size=int(number(get("max_code_size"), 1_048_576, 1024)),
        mode="all" if get("mode") == "all" else "latest",
        ignore_cache=bool(get("ignore_cache", False)),
        exclude_pids=excluded_pids(get("exclude_pids")) if isinstance(get("exclude_pids"), str) else tuple(get("exclude_pids") or ()),
        thresholds=thresholds(get("identical"), get("high"), get("suspected")),
    )


def resolve_user(users: DataFrame, text: str | None) -> int | None:
    """A user's id from an id, a name or a mail address, in this order; None (no filter) if none is known.

    users: uid, name, mail.  Only the rows that match are read; of several users of one name the smallest id counts.
    """
    key = (text or "").strip()
    if not key:
        return None
    by_id = F.col("uid") == int(key) if re.fullmatch(r"\d{1,18}", key) else F.lit(False)
    tests = [by_id, F.lower("name") == key.lower(), F.lower("mail") == key.lower()]
    place = F.coalesce(*[F.when(t, i) for i, t in enumerate(tests)])
    found = users.where(place.isNotNull()).agg(F.min(F.struct(place.alias("place"), "uid")).alias("m")).first()["m"]
    return found and found["uid"]
