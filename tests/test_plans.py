"""The plans are the ones wanted: no nested loops, filters and columns pushed into the scan."""

import os
import re

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["group_dice", "candidates", "sim_histogram", "trivial_pids", "member_pairs", "dice_pairs", "tfidf_cosine", "user_summary", "graph_nodes", "graph_stats", "diagnostics", "cache_split", "dim_label", "sweep_candidates", "line_diff", "exclude_pids"])
def test_no_nested_loops(spark, name):
    import __spark_entry__ as e

    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(e.queries()[name](spark, SMALL)))


def test_pushdown_and_pruning(spark):
    from kinprint.sources.tables import counted_features

    text = plan(counted_features(spark, SMALL, "tf"))
    assert "EqualTo(k,8)" in text and "EqualTo(schema_version,3)" in text
    assert re.search(r"ReadSchema: struct<rid:bigint,k:int,tf:map<string,int>,schema_version:int>|ReadSchema: struct<rid:bigint,k:int,schema_version:int,tf:map<string,int>>", text)


def test_latest_is_a_combining_aggregate(spark):
    import __spark_entry__ as e

    text = plan(e.queries()["latest_per_key"](spark, SMALL))
    assert "Window" not in text and text.count("Aggregate") >= 2
