"""The registered queries on training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.llm import components, mixing, neardup, oracle, packing, quality, setjoin, spans, terms, tokens
from kinprint.session import Workspace
from kinprint.sources.tables import counted_features, table

MIN_TOKENS = 40


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of linked submissions and users over all pair rows."""
    return components.pair_groups(table(spark, folder, "pairs").select("rid1", "rid2", "uid1", "uid2"), Workspace(spark, "p1"))


def _sets(spark: SparkSession, folder: str, column: str) -> DataFrame:
    rows = counted_features(spark, folder, column, "token_count").where(F.col("token_count") >= MIN_TOKENS)
    return rows.select(F.col("rid").alias("id"), F.col(column).alias("elems"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "known_solutions").where(F.col("ref_id").isNotNull()).select(F.col("ref_id").alias("id"), F.col("hashes").alias("elems"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Similar pairs among features (lex_base_hashes, 0.75) and between known solutions and features (hashes, 0.5)."""
    links, copies = setjoin.similar_within(_sets(spark, folder, "lex_base_hashes"), 0.75, Workspace(spark, "p3a"))
    found, of_known, of_rows = setjoin.similar_between(_known(spark, folder), _sets(spark, folder, "hashes"), 0.5, Workspace(spark, "p3b"))
    return setjoin.expand_within(links, copies).unionByName(setjoin.expand_between(found, of_known, of_rows))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Per counted row its class of equal lexical sets and the number of other classes it is similar to."""
    sets = _sets(spark, folder, "lex_base_hashes")
    links, copies = setjoin.similar_within(sets, 0.75, Workspace(spark, "p3c"))
    both = links.select(F.col("id1").alias("class_id")).unionByName(links.select(F.col("id2").alias("class_id")))
    return setjoin.class_counts(sets, copies, both).withColumnRenamed("id", "rid")


def p3_known(spark: SparkSession, folder: str) -> DataFrame:
    """Per known solution and per counted row (side) its class of equal hash sets and the number of classes of the other side it is similar to."""
    known, sets = _known(spark, folder), _sets(spark, folder, "hashes")
    links, of_known, of_rows = setjoin.similar_between(known, sets, 0.5, Workspace(spark, "p3d"))
    sides = (("known", known, of_known, "id1"), ("row", sets, of_rows, "id2"))
    one, two = (setjoin.class_counts(s, copies, links.select(F.col(end).alias("class_id"))).select(F.lit(side).alias("side"), "*") for side, s, copies, end in sides)
    return one.unionByName(two)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near copies by the Dice similarity of k-gram sets."""
    return neardup.near_copy_groups(_sets(spark, folder, "hashes"), 0.75, Workspace(spark, "p4"))


def _tf(spark: SparkSession, folder: str) -> DataFrame:
    return counted_features(spark, folder, "tf")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The most telling keyword of every counted row, scored n * ln(1 + N / df)."""
    return terms.top_term(terms.scored_terms(_tf(spark, folder), Workspace(spark, "p5"), "tf_idf")).select("rid", "term")


def p5_log_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Every keyword of every counted row with its log-entropy score."""
    scored = terms.scored_terms(_tf(spark, folder), Workspace(spark, "p5e"))
    return scored.select("rid", "term", "n", F.round("score", 6).alias("score"))


def p5_telling(spark: SparkSession, folder: str) -> DataFrame:
    """The most telling keyword of every counted row by log-entropy (scores compared at nine decimals)."""
    return terms.top_term(terms.scored_terms(_tf(spark, folder), Workspace(spark, "p5t")), 9).select("rid", "term", F.round("score", 6).alias("score"))


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    return counted_features(spark, folder, "base_hashes").withColumnRenamed("base_hashes", "seq")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of base_hashes that also stand in another submission."""
    return spans.shared_spans(_sequences(spark, folder), Workspace(spark, "p6"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per counted row how much of its token sequence stands in another submission."""
    rows = _sequences(spark, folder)
    return spans.shared_shares(rows, spans.shared_spans(rows, Workspace(spark, "p6s"))).withColumn("share", F.round("share", 9))


def _token_counts(spark: SparkSession, folder: str, work: Workspace) -> DataFrame:
    return work.write(tokens.with_token_counts(table(spark, folder, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text")))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All texts in containers of every capacity of pack_specs."""
    return packing.packed(_token_counts(spark, folder, Workspace(spark, "p7")), table(spark, folder, "pack_specs"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and used room per capacity."""
    return packing.container_report(p7_packed(spark, folder), table(spark, folder, "pack_specs"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity the texts packed and how many texts or containers break a rule of packing."""
    work = Workspace(spark, "p7c")
    counts, specs = _token_counts(spark, folder, work), table(spark, folder, "pack_specs")
    return packing.packing_faults(work.write(packing.packed(counts, specs)), counts, specs)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mixture and how often each is taken."""
    work = Workspace(spark, "p8")
    return mixing.mixture(_token_counts(spark, folder, work), table(spark, folder, "mix_targets"), work)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached per source."""
    work = Workspace(spark, "p8s")
    return mixing.mixture(_token_counts(spark, folder, work), table(spark, folder, "mix_targets"), work)[1]


def p8_full(spark: SparkSession, folder: str) -> DataFrame:
    """Shares and shortfalls per source of a mixture as large as all sources together, in which small sources meet their cap of repeats."""
    work = Workspace(spark, "p8f")
    return mixing.mixture(_token_counts(spark, folder, work), table(spark, folder, "mix_targets"), work, mixing.ALL)[1]


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the texts there are and how many break a rule in the mixture as large as all sources together."""
    work = Workspace(spark, "p8c")
    counts = _token_counts(spark, folder, work)
    return mixing.mixture_faults(*mixing.mixture(counts, table(spark, folder, "mix_targets"), work, mixing.ALL), counts)


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, distance from prose and contributions of every document."""
    return quality.text_quality(table(spark, folder, "documents"), table(spark, folder, "common_words"), Workspace(spark, "p9"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not mostly running sentences."""
    return quality.not_prose(p9_quality(spark, folder))


def p9_far(spark: SparkSession, folder: str) -> DataFrame:
    """Documents beyond the cutoff as a whole, with their distance and the statistic that contributes most."""
    return quality.far_from_prose(p9_quality(spark, folder)).withColumn("distance", F.round("distance", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p3_found, p3_links, p3_known, p4_found, p5_found, p5_log_entropy, p5_telling, p6_found, p6_shares, p7_packed, p7_report, p7_checks, p8_mixture, p8_shares, p8_full, p8_checks, p9_quality, p9_far, p9_found)}
SQL: dict[str, str] = oracle.SQL
