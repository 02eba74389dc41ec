"""The engine as objects: contests and scans of one data folder, and the results of a scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprint.functions import artifacts, lexer, metrics
from kinprint.operators import contests, latest
from kinprint.plans import report
from kinprint.plans.scan import ScanConfig, report_stats, scan
from kinprint.session import Workspace
from kinprint.sources import store
from kinprint.sources.tables import table


class Engine:
    """Tables of a folder (submissions, features, contests, reports), or any DataFrames given by name."""

    def __init__(self, spark: SparkSession, folder: str | None = None, **tables: DataFrame):
        self.spark, self.folder, self._tables = spark, folder, tables

    def table(self, name: str) -> DataFrame:
        return self._tables[name] if name in self._tables else table(self.spark, self.folder, name)

    def contests(self, scope: str = "both") -> DataFrame:
        return contests.listed(self.table("contests"), scope)

    def reports(self) -> DataFrame:
        return contests.latest_reports(self.table("reports"))

    def queue(self, now: str) -> DataFrame:
        return contests.queue(self.table("reports"), now)

    def due(self, now: str, **limits: int) -> DataFrame:
        """Contests that a sweep would scan."""
        return contests.without_report(contests.ended(self.table("contests"), now, **limits), self.table("reports"), now)

    def diagnostics(self) -> DataFrame:
        return contests.diagnostics(self.table("submissions"), self.table("features"))

    def scan(self, config: ScanConfig = ScanConfig(), tid: str | None = None, blobs: DataFrame | None = None) -> Report:
        """Scan one contest, or all of them in one job."""
        rows = self.table("submissions")
        if tid is not None:
            rows = rows.where(F.col("tid") == tid)
        work = Workspace(self.spark, "scan")
        pairs, docs, state = scan(rows, self.table("features"), work, config, blobs)
        return Report(work.write(pairs), docs, state, rows, blobs)


class Report:
    """Pairs of a scan and everything that is read from them."""

    def __init__(self, pairs: DataFrame, docs: DataFrame, state: DataFrame, submissions: DataFrame, blobs: DataFrame | None = None):
        self.all_pairs, self.docs, self.state, self._submissions, self._blobs = pairs, docs, state, submissions, blobs

    def pairs(self, level: int = 1, pid: int | None = None, user: int | None = None, metric: str | None = None, at_least: float | None = None, page: int | None = None) -> DataFrame:
        found = report.pair_filter(self.all_pairs, level, pid, user, metric, at_least)
        return found if page is None else report.page(found, page, metric)

    def stats(self) -> DataFrame:
        return report_stats(self.docs, self.all_pairs, self.state)

    def users(self) -> DataFrame:
        return report.user_summary(self.all_pairs)

    def user_problems(self) -> DataFrame:
        return report.user_problem(self.all_pairs)

    def graph(self, titles: DataFrame, names: DataFrame, min_level: int = 1, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, counts) of all pairs or the `most` similar ones; titles: pid, title; names: uid, name."""
        pairs = self.all_pairs if most is None else report.strongest(self.all_pairs, most)
        edges = report.graph_edges(pairs, titles, min_level)
        return report.graph_nodes(edges, names), edges, report.graph_stats(pairs, min_level)

    def diff(self, rid1: int, rid2: int, beside: bool = False) -> DataFrame:
        """Line diff of two submissions, or their lines beside each other."""
        texts = latest.source_text(self._submissions.where(F.col("rid").isin([rid1, rid2])), self._blobs).select("rid", "source").dropDuplicates(["rid"])
        a, b = (texts.where(F.col("rid") == r).select(F.col("source").alias(f"text{n}"), F.lit(r).alias(f"rid{n}"), F.lit(1).alias("one")) for n, r in ((1, rid1), (2, rid2)))
        make = report.side_by_side if beside else report.line_diffs
        return make(a.join(b, "one"), "text1", "text2", ["rid1", "rid2"])

    def save(self, root: str) -> None:
        """Replace these contests' pairs in a table partitioned by domain and contest."""
        store.replace_pairs(self.all_pairs, root, self.docs.select("domain_id", "tid").distinct())


def register(spark: SparkSession) -> None:
    """Make the text and sequence functions callable from SQL: language_family, token_text, fnv32a, seq_similarity, line_diff."""
    spark.udf.register("language_family", F.pandas_udf(_families, T.StringType()))
    spark.udf.register("token_text", F.pandas_udf(_token_texts, T.StringType()))
    spark.udf.register("fnv32a", F.pandas_udf(_hashes, T.LongType()))
    spark.udf.register("seq_similarity", metrics.seq_similarity)
    spark.udf.register("line_diff", metrics.line_diff)


def _families(lang: pd.Series) -> pd.Series:
    return lang.map(lexer.language_family)


def _token_texts(code: pd.Series, lang: pd.Series) -> pd.Series:
    texts = [artifacts.well_formed(artifacts.token_text(lexer.lex(lexer.code_units(c or ""), lexer.language_family(x)).values)) for c, x in zip(code, lang)]
    return pd.Series(texts, dtype="object")


def _hashes(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else artifacts.fnv32a(lexer.code_units(t)) for t in text], dtype="object")
