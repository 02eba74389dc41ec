"""Text quality by robust Mahalanobis distance from the prose of each language.

All statistics of a text are one vector.  Each language's prose has a mean and a
regularised covariance of these vectors, and a text's squared Mahalanobis
distance splits into what each statistic contributes.  The same is done for
stretches of a text (whole lines of about 80 to 240 characters), because a text
of prose and list is seen as both only by its stretches.

The fit is robust by concentration steps: it starts from rows that are plainly
prose and is repeated on the rows within the chi-square cutoff, whose trimmed
covariance is brought back to scale by a consistency factor.  Only these moments,
of at most six languages, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.llm import prose
from kinprint.session import Workspace, spread

D = len(prose.STATISTICS)
#: Rounds of refitting, and the share of prose that lies within the cutoff.
STEPS, INSIDE = 4, 0.975
#: Weight of the variances of all rows, prose or not, in each covariance: prose that is all alike must not make the distance boundless.
RIDGE = 0.1
#: Rows at which a language's own mean and covariance count as much as those of all languages together.
ENOUGH = 30
#: What is measured: stretches of texts, and whole texts.
KINDS = ("stretch", "text")

_DDL = "doc_id bigint, weight int, lang string, s array<double>, text_lang string, whole array<double>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("weight", pa.int32()), ("lang", pa.string()), ("s", pa.list_(pa.float64())), ("text_lang", pa.string()), ("whole", pa.list_(pa.float64()))])


def chi_square(x: float, d: int) -> float:
    """P(chi-square of d degrees <= x)."""
    if x <= 0:
        return 0.0
    term, total, k = math.exp(-x / 2 + d / 2 * math.log(x / 2) - math.lgamma(d / 2 + 1)), 0.0, 0
    while term > 1e-17 or k < x / 2:
        total, k = total + term, k + 1
        term *= x / 2 / (d / 2 + k)
    return min(1.0, total)


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 100.0 * d
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, d) < p else (low, middle)
    return high


#: Squared distance beyond which a row is no prose, and the factor that undoes the trimming at it.
CUTOFF = chi_square_quantile(INSIDE, D)
CONSISTENCY = INSIDE / chi_square(CUTOFF, D + 2)


def common_words(table: DataFrame) -> dict[str, frozenset]:
    """The common words by language, without case, padding and repeats (a settings table; more than 100 000 rows are refused)."""
    rows = table.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is a settings table of at most 100000 rows")
    out: dict[str, set] = {}
    for r in rows:
        if r["word"].strip():
            out.setdefault(r["lang"].strip().lower(), set()).add(r["word"].strip().lower())
    return {k: frozenset(v) for k, v in out.items()}


def _by_language(lang) -> list[tuple[str, np.ndarray]]:
    """Each language of a column (or an array of names) with the mask of its rows."""
    coded = (lang if isinstance(lang, pa.Array) else pa.array(list(lang), pa.string())).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return [(name, codes == i) for i, name in enumerate(coded.dictionary.to_pylist())]


def _measure(words: dict[str, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = prose.Common(words)
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids, weights, langs, values, text_langs, wholes = [], [], [], [], [], []
            for doc_id, declared, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                parts, whole, text_lang = prose.measured(text, declared, common)
                if whole is None:
                    continue
                own = [part.language(common, text_lang) for part in parts]
                ids += [doc_id] * len(parts)
                weights += [part.chars for part in parts]
                langs += own
                values += [part.statistics(lang, common) for part, lang in zip(parts, own)]
                text_langs += [text_lang] + [None] * (len(parts) - 1)
                wholes += [[float(whole.words), float(whole.lines), *whole.statistics(text_lang, common)]] + [None] * (len(parts) - 1)
            flat = np.array(values, dtype=np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * D), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weights, pa.int32()), pa.array(langs, pa.string()), lists, pa.array(text_langs, pa.string()), pa.array(wholes, pa.list_(pa.float64()))], schema=_SCHEMA)

    return run


class Model:
    """Mean and inverse covariance by language; '*' is a language without any.

    moments: by language the count, sums and products of the rows of prose; spread: the variances of all rows.
    A language's own moments are drawn to those of all languages by ENOUGH / (ENOUGH + rows).
    """

    def __init__(self, moments: dict[str, np.ndarray], spread: np.ndarray):
        total = sum(moments.values(), np.zeros(1 + D + D * D))
        ridge = RIDGE * np.diag(np.maximum(spread, 1e-6))
        self.mean: dict[str, np.ndarray] = {}
        self.inverse: dict[str, np.ndarray] = {}
        shared_mean, shared_cov = self._fit(total)
        for lang, m in {**moments, "*": np.zeros_like(total)}.items():
            own = m[0] / (m[0] + ENOUGH)
            mean, cov = self._fit(m)
            self.mean[lang] = own * mean + (1 - own) * shared_mean
            self.inverse[lang] = np.linalg.inv((1 - RIDGE) * CONSISTENCY * (own * cov + (1 - own) * shared_cov) + ridge)

    @staticmethod
    def _fit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(m[0], 1.0)
        mean = m[1 : 1 + D] / n
        return mean, m[1 + D :].reshape(D, D) / n - np.outer(mean, mean)

    def contributions(self, lang, s: np.ndarray) -> np.ndarray:
        """What each statistic adds to the squared distance of each row."""
        out = np.zeros_like(s)
        for name, at in _by_language(lang):
            key = name if name in self.mean else "*"
            d = s[at] - self.mean[key]
            out[at] = d * (d @ self.inverse[key])
        return out


def _rows(batch: pa.RecordBatch) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Languages and statistics of the batch's stretches and of its whole texts."""
    whole = batch.select([4, 5]).filter(batch.column(4).is_valid())
    return {
        "stretch": (batch.column(2), np.asarray(batch.column(3).flatten()).reshape(-1, D)),
        "text": (whole.column(0), np.asarray(whole.column(1).flatten()).reshape(-1, D + len(prose.COUNTS))[:, len(prose.COUNTS) :]),
    }


def _surely_prose(lang, s: np.ndarray) -> np.ndarray:
    """Where the fit starts: many common words, hardly anything but words, whole lines of them."""
    column = {name: s[:, k] for k, name in enumerate(prose.STATISTICS)}
    enough = np.full(len(s), 0.25)
    for name, at in _by_language(lang):
        if name == "zh":
            enough[at] = 0.1
    return (column["common_share"] > enough) & (column["plain_share"] > 0.8) & (column["odd_share"] < 0.1) & (column["bullet_share"] < 0.5) & (column["line_words"] > 1.6)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)))


def _moments(models: dict[str, Model] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for kind, (lang, s) in _rows(batch).items():
                keep = _surely_prose(lang, s) if models is None else models[kind].contributions(lang, s).sum(axis=1) < CUTOFF
                for name, at in _by_language(lang):
                    if (at & keep).any():
                        sums[kind, name] = sums.get((kind, name), 0) + _sums(s[at & keep])
                if models is None:
                    sums[kind, ""] = sums.get((kind, ""), 0) + _sums(s)
        for (kind, name), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(v)), pa.array([name] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["kind", "lang", "k", "v"])

    return run


def fit(measured: DataFrame, steps: int = STEPS) -> dict[str, Model]:
    """The models of stretches and of texts: one pass over all rows for the start and for each step, fewer once no row changes sides."""
    models, spreads, before = None, {}, None
    for _ in range(steps + 1):
        rows = measured.mapInArrow(_moments(models), "kind string, lang string, k int, v double").groupBy("kind", "lang", "k").agg(F.sum("v").alias("v")).collect()
        moments: dict[str, dict[str, np.ndarray]] = {kind: {} for kind in KINDS}
        for r in rows:
            moments[r["kind"]].setdefault(r["lang"], np.zeros(1 + D + D * D))[r["k"]] = r["v"]
        if models is None:
            spreads = {kind: np.diag(Model._fit(m.pop("", np.zeros(1 + D + D * D)))[1]) for kind, m in moments.items()}
        counts = {(kind, lang): v[0] for kind, m in moments.items() for lang, v in m.items()}
        if counts == before:
            break
        models, before = {kind: Model(m, spreads[kind]) for kind, m in moments.items()}, counts
    return models


def _distances(models: dict[str, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch)
            odd = models["stretch"].contributions(*rows["stretch"]).sum(axis=1) > CUTOFF
            parts = models["text"].contributions(*rows["text"])
            at = np.asarray(batch.column(4).is_valid())
            ends = np.concatenate(([0], np.cumsum(at))).astype(np.int32) * D
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=None), pa.array(np.ascontiguousarray(parts).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd), batch.column(4), batch.column(5), lists], names=["doc_id", "weight", "odd", "text_lang", "whole", "parts"])

    return run


def text_quality(documents: DataFrame, words: DataFrame, work: Workspace) -> DataFrame:
    """Per document its language, statistics, distance from prose, what each statistic contributes, and the share that is no prose.

    documents: doc_id (unique), lang, text.  n_words, n_lines, the statistics, distance and contributions (<statistic>_part, which
    add up to distance squared) are the whole text's own; outlier_share is the share of
    its non-blank characters in stretches beyond the cutoff.  Null and blank texts have n_chars, n_words and n_lines 0
    and nulls; a null doc_id is no document.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    measured = work.write(spread(rows).mapInArrow(_measure(common_words(words)), _DDL))
    judged = measured.mapInArrow(_distances(fit(measured)), "doc_id bigint, weight int, odd boolean, text_lang string, whole array<double>, parts array<double>")
    per = judged.groupBy("doc_id").agg(
        F.sum("weight").alias("n_chars"), F.max("text_lang").alias("language"), F.max("whole").alias("whole"), F.max(F.when(F.size("parts") > 0, F.col("parts"))).alias("parts"),
        (F.sum(F.when(F.col("odd"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("outlier_share"),
    )
    counts = [F.col("whole")[k].cast("bigint").alias(name) for k, name in enumerate(prose.COUNTS)]
    own = [F.col("whole")[k + len(counts)].alias(name) for k, name in enumerate(prose.STATISTICS)]
    shares = [F.col("parts")[k].alias(f"{name}_part") for k, name in enumerate(prose.STATISTICS)]
    distance = F.sqrt(F.greatest(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))).alias("distance")
    per = per.select("doc_id", "n_chars", "language", *counts, *own, distance, "outlier_share", *shares)
    ids = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return ids.join(per, "doc_id", "left").fillna(0, ["n_chars", *prose.COUNTS])


def not_prose(quality: DataFrame) -> DataFrame:
    """Documents of which more than half of the non-blank characters are no prose."""
    return quality.where(F.col("outlier_share") > 0.5).select("doc_id")


def far_from_prose(quality: DataFrame) -> DataFrame:
    """Documents beyond the cutoff as a whole, with the statistic that contributes most: doc_id, distance, main_statistic."""
    most = F.array_max(F.array(*[F.struct(F.col(f"{name}_part").alias("p"), F.lit(name).alias("name")) for name in prose.STATISTICS]))["name"]
    return quality.where(F.col("distance") ** 2 > CUTOFF).select("doc_id", "distance", most.alias("main_statistic"))
