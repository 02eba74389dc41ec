"""Groups of equal normalised sources within a scope (domain, contest, problem)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ["domain_id", "tid", "pid"]


def code_groups(docs: DataFrame, scope: list[str] = SCOPE, carried: tuple[str, ...] = (), newest_first: bool = True) -> DataFrame:
    """One row a (scope, code_hash): rep (the first rid seen), n_docs and the representative's carried columns."""
    pick = F.max if newest_first else F.min
    by = F.max_by if newest_first else F.min_by
    return docs.groupBy(*scope, "code_hash").agg(pick("rid").alias("rep"), F.count(F.lit(1)).alias("n_docs"), *[by(c, "rid").alias(c) for c in carried])


def group_members(docs: DataFrame, scope: list[str] = SCOPE, newest_first: bool = True) -> DataFrame:
    """One rid a (scope, code_hash, uid): the first seen."""
    pick = F.max if newest_first else F.min
    by = F.max_by if newest_first else F.min_by
    return docs.groupBy(*scope, "code_hash", "uid").agg(pick("rid").alias("rid"), by("lang", "rid").alias("lang"))


def document_frequency(groups: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Per scope and term the number of groups that have it; groups carry tf.  Every key of tf counts."""
    return groups.select(*scope, F.explode(F.map_keys("tf")).alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
