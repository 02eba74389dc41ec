import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinprint.functions import hashing, metrics
from kinprint.functions.metrics import lcs_length, line_diff_of, seq_similarity_of
from kinprint.plans import config


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def longs(*xs):
    return F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")


def test_dice(spark):
    assert value(spark, metrics.dice(longs(1, 2, 3, 4), longs(2, 3, 4, 5))) == 0.75
    assert value(spark, metrics.dice(longs(*range(0, 2000, 2)), longs(2, 4, 6, 8))) == 8 / 1004
    assert value(spark, metrics.dice(longs(), longs(1))) == 0
    assert value(spark, metrics.dice_or_null(longs(), longs(1))) is None


@pytest.mark.parametrize("sim,level", [(1, 3), (0.95, 3), (0.949, 2), (0.75, 2), (0.749, 1), (0.55, 1), (0.549, 0)])
def test_classify(spark, sim, level):
    assert value(spark, metrics.classify(F.lit(sim))) == level


def test_classify_pair(spark):
    cases = [
        *[(s, x, v, False, n) for s, x, v, n in [(1, 0.2, 0.1, 2), (1, 0.9, None, 3), (1, None, 0.7, 3), (1, 0.85, None, 3), (1, None, 0.6, 3), (1, None, None, 2), (0.9, 0, 0, 2), (0.75, 0, 0, 2), (0.55, 0, 0, 1), (0.5, 1, 1, 0)]],
        *[(s, x, v, True, n) for s, x, v, n in [(1, 0.97, 0.9, 3), (1, 0.97, None, 3), (1, 0.97, 0.8, 3), (1, 0.97, 0.5, 2), (1, 0.8, 0.9, 2), (1, 0.55, None, 1), (1, 0.3, 0.3, 0), (0.8, None, None, 2)]],
    ]
    df = spark.createDataFrame([tuple(float(c) if isinstance(c, (int, float)) and not isinstance(c, bool) else c for c in r[:4]) + (r[4],) for r in cases], "s double, x double, v double, t boolean, n int")
    assert df.where(metrics.classify_pair(F.col("s"), F.col("x"), F.col("v"), F.col("t")) != F.col("n")).count() == 0


def test_rounding(spark):
    assert value(spark, hashing.round4(F.lit(1262) / F.lit(1600))) == 0.7887
    assert value(spark, metrics.percent(F.lit(0.12345))) == 12.3 and value(spark, metrics.heat(F.lit(None).cast("double"))) == "na"


def test_functions_names_vectors(spark):
    f = lambda *xs: F.array(*[F.struct(F.lit("f").alias("name"), F.lit(n).alias("len"), F.lit(h).cast("bigint").alias("hash")) for n, h in xs]).cast("array<struct<name:string,len:int,hash:bigint>>")
    assert value(spark, metrics.func_similarity(f((10, 1), (30, 2)), f((30, 2)))) == 60 / 70
    assert value(spark, metrics.func_similarity(f((10, 1)), f((30, 2)))) == 0
    assert value(spark, metrics.func_similarity(f(), f())) is None and value(spark, metrics.func_similarity(f(), f((3, 1)))) == 0
    names = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert value(spark, metrics.var_similarity(names("alpha", "beta", "i"), names("alpha", "gamma", "j"))) == 0.5
    assert value(spark, metrics.var_similarity(names("ans", "tmp"), names("ans"))) is None
    d = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert value(spark, metrics.cosine(d(1, 2, 3), d(2, 4, 6))) == pytest.approx(1) and value(spark, metrics.cosine(d(1, 0, 0), d(0, 1, 0))) == 0
    assert value(spark, metrics.cosine(d(0, 0), d(1, 1))) is None
    assert value(spark, metrics.shared_count(longs(1, 3, 5, 7, 9), longs(3, 4, 7, 10))) == 2
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(float(v)))])
    assert value(spark, metrics.map_cosine(m(a=2), m(a=5))) == pytest.approx(1) and value(spark, metrics.map_cosine(m(a=1), m(b=1))) == 0


def naive_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert lcs_length(a, b) == naive_lcs(a, b)


def test_seq_similarity(spark):
    assert seq_similarity_of("xyz", "zxz") == 2 / 3 and seq_similarity_of(np.zeros(3000), np.zeros(3000)) is None and seq_similarity_of([], [1]) is None
    df = spark.createDataFrame([([1, 2], [1, 2]), ([], [1]), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(metrics.seq_similarity("a", "b")).collect()] == [1.0, None, None]


def test_line_diff(spark):
    rows = line_diff_of(["a", "b", "c"], ["a", "x", "c", "d"])
    assert [(r["l"], r["r"], r["type"]) for r in rows] == [(1, 1, "eq"), (2, None, "del"), (None, 2, "ins"), (3, 3, "eq"), (None, 4, "ins")]
    assert all(r["type"] == "eq" for r in line_diff_of([" a", "b\t"], ["a", "b"])) and line_diff_of(["a"] * 3000, ["b"] * 3000, 1_000_000) is None
    df = spark.createDataFrame([(["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [tuple(x) for x in df.select(metrics.line_diff("a", "b")).first()[0]] == [(1, 1, "eq"), (None, 2, "ins")]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=100, deadline=None)
def test_line_diff_rebuilds_both(a, b):
    rows = line_diff_of(a, b)
    assert [a[r["l"] - 1] for r in rows if r["l"]] == a and [b[r["r"] - 1] for r in rows if r["r"]] == b
    assert sum(r["type"] == "eq" for r in rows) == naive_lcs(a, b)


def test_config():
    t = config.thresholds("0.9", 0.95, 0.01)
    assert (t.identical, t.high, t.suspected) == (0.95, 0.95, 0.55)
    assert config.excluded_pids("3, 1;2，x 0 3") == (1, 2, 3) and config.excluded_pids(None) == ()
    c = config.scan_config({"k": 1, "max_code_size": "10", "min_tokens": -3, "mode": "all"})
    assert (c.k, c.max_code_size, c.min_tokens, c.mode) == (2, 1024, 0, "all") and config.scan_config({}).k == 8


def test_users(spark):
    users = spark.createDataFrame([(7, "Ann", "a@b"), (3, "ann", None), (9, "7", "x@y"), (None, "nobody", None)], "uid bigint, name string, mail string")
    find = lambda text: config.resolve_user(users, text)
    assert (find("7"), find(" ANN "), find("X@y"), find("b@c"), find("nobody"), find(""), find(None), find("9" * 30)) == (7, 3, 9, None, None, None, None, None)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc "), max_size=12))
@settings(max_examples=200, deadline=None)
def test_line_diff_against_the_recurrence(a, b):
    x, y = [s.strip() for s in a], [s.strip() for s in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    for row in line_diff_of(a, b):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            i, j, want = i + 1, j + 1, "eq"
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            i, want = i + 1, "del"
        else:
            j, want = j + 1, "ins"
        assert (row["type"], row["l"], row["r"]) == (want, i if want != "ins" else None, j if want != "del" else None)
    assert (i, j) == (len(x), len(y))
