import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinprint.operators import overlap, simjoin
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"
DDL = "domain_id string, tid string, pid bigint, rep bigint, fps array<bigint>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sets_of(seed, n, least=0):
    """Sets of values of 32 and 64 bits; the first ten values are in nearly all of them."""
    rnd = random.Random(seed)
    pool = [*range(30), *(2**32 - 1 - i for i in range(30))] + ([-5, 2**40] if seed % 2 else [])
    return [sorted({*(x for x in range(10) if rnd.random() < 0.95), *rnd.sample(pool, rnd.randrange(least, 12))}) if rnd.random() < 0.95 else [] for _ in range(n)]


def brute(sets, scope):
    found = {}
    for i, j in combinations(range(len(sets)), 2):
        n = len(set(sets[i]) & set(sets[j]))
        if n and scope(i) == scope(j):
            found[(i, j)] = n
    return found


@pytest.mark.parametrize("most,few", [(2000, 10_000), (7, 10_000), (7, 0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_histogram_by_blocks(spark, monkeypatch, seed, most, few):
    """Whole or in blocks, few values or those that nearly all sets hold: the pairs of brute force."""
    monkeypatch.setattr(overlap, "SETS", most)
    monkeypatch.setattr(overlap, "FEW", few)
    sets = sets_of(seed, 180)
    scope = lambda i: 0 if i < 150 else i % 3
    data = [("d", "t", scope(i), i, s) for i, s in enumerate(sets)] + [("d", None, 1, 900 + i, [1, 2]) for i in range(3)]
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, DDL)
    want = brute(sets, scope)
    assert {(r.rep1, r.rep2): r.common for r in simjoin.overlapping_pairs(df).collect()} == want
    assert simjoin.overlapping_pairs(df).count() == len(want)
    hist = Counter((scope(i), min(100, int(2.0 * n / (len(sets[i]) + len(sets[j])) * 100 + 0.5))) for (i, j), n in want.items())
    sizes = Counter(scope(i) for i in range(len(sets)))
    for s, g in sizes.items():
        hist[(s, 0)] += g * (g - 1) // 2 - sum(1 for i, _ in want if scope(i) == s)
    got = simjoin.full_histogram(df)
    assert {(r.pid, r.bucket): r.n for r in got.where("tid is not null").collect()} == {k: n for k, n in hist.items() if n}
    assert rows(got.where("tid is null").select("bucket", "n")) == [(0, 3)]  # a null contest equals none, but its pairs are counted
    assert rows(got) == rows(simjoin.histogram(simjoin.overlapping_pairs(df), df))


@pytest.mark.parametrize("meetings", [1, 50, 10**6])
def test_counts(monkeypatch, meetings):
    monkeypatch.setattr(overlap, "MEETINGS", meetings)
    for left, right in ((1, 0), (90, 0), (40, 90), (1, 1)):
        sets = sets_of(left, left + right)
        values, owner = np.array([v for s in sets for v in s], dtype=np.int64), np.repeat(np.arange(left + right), [len(s) for s in sets])
        turn = np.random.default_rng(1).permutation(len(values))
        got = overlap._counts(values[turn], owner[turn], left, right)
        want = np.array([[len(set(a) & set(b)) if right or i < j else 0 for j, b in enumerate(sets[left:] if right else sets)] for i, a in enumerate(sets[:left])])
        assert (got == want).all()


def test_meetings_of_values_are_not_shuffled(spark):
    """Neither a join on values nor an aggregate by pair: the only shuffle is that of the sets."""
    df = spark.createDataFrame([("d", "t", 1, i, [1, 2, i]) for i in range(5)], DDL).where(F.col("rep") >= 0)
    text = plan(simjoin.overlapping_pairs(df))
    assert "Join" not in text and "Aggregate" not in text and text.count("Exchange") == 1
    assert "rep1" not in plan(simjoin.full_histogram(df))


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert simjoin.overlapping_pairs(df).count() == 0 and simjoin.full_histogram(df).count() == 0
    df = spark.createDataFrame([("d", "t", 1, 1, []), ("d", "t", 1, 2, [])], DDL)
    assert simjoin.overlapping_pairs(df).count() == 0 and rows(simjoin.full_histogram(df).select("bucket", "n")) == [(0, 1)]


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["sim_histogram", "sim_median"])
def test_statistics_list_no_pairs(spark, name):
    import __spark_entry__ as e

    assert "rep1" not in plan(e.queries()[name](spark, SMALL))
