"""How distinctive a term is for a record, from two SQL aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.operators.skew import salted_join
from kinprint.session import Workspace


def term_counts(records: DataFrame) -> DataFrame:
    """rid, term, n from rows (rid, tf map): counts below 1 and null counts are left out, a repeated rid counts once."""
    rows = records.select("rid", F.explode("tf").alias("term", "n")).where(F.col("n") >= 1)
    return rows.groupBy("rid", "term").agg(F.max("n").cast("bigint").alias("n"))


def term_weights(counts: DataFrame, n_records: int) -> DataFrame:
    """The first aggregation, per term: df, total and the global weights of both schemes.

    entropy_weight is 1 - H / ln(N), H being the entropy of the term's spread over
    the records: ln(total) - sum(n ln n) / total.  It is 1 for a term of one record,
    0 for one spread evenly over all; with a single record every term weighs 1.
    idf_weight is ln(1 + N / df).
    """
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.log("total") - F.col("nlogn") / F.col("total")
    weight = 1 - entropy / F.log(F.lit(float(n_records))) if n_records > 1 else F.lit(1.0)
    return spread.select("term", "df", "total", F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)).alias("entropy_weight"), F.log(1 + F.lit(float(n_records)) / F.col("df")).alias("idf_weight"))


def scored_terms(records: DataFrame, work: Workspace, scheme: str = "log_entropy") -> DataFrame:
    """rid, term, n, df, score of every term of every record.

    records: (rid, tf map<string,int>).  scheme log_entropy scores
    ln(1 + n) * entropy_weight; tf_idf scores n * ln(1 + N / df).  Records with a null
    or empty map count in N and have no rows; a null rid is no record.
    A term may stand in every record: weights are joined with salted keys.
    """
    records = records.where(F.col("rid").isNotNull())
    n_records = records.select("rid").distinct().count()
    counts = work.write(term_counts(records))
    weights = term_weights(counts, n_records)
    joined = salted_join(counts, weights, ["term"], ["rid"])
    score = F.log1p("n") * F.col("entropy_weight") if scheme == "log_entropy" else F.col("n") * F.col("idf_weight")
    return joined.select("rid", "term", "n", "df", score.alias("score"))


def top_term(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """The second aggregation: each record's term of greatest score (of equal ones the first in binary order): rid, term, score.

    decimals: scores that agree up to so many decimals count as equal; sums of logarithms differ in the last bits with the order of rows.
    """
    score = F.col("score") if decimals is None else F.round("score", decimals)
    best = scored.groupBy("rid").agg(F.min(F.struct((-score).alias("s"), F.col("term").alias("t"))).alias("b"))
    return best.select("rid", F.col("b.t").alias("term"), (-F.col("b.s")).alias("score"))
