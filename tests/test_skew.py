import random

from kinprint.operators import latest, skew
from tests.conftest import rows

DDL = "tid string, pid bigint, rid1 bigint, rid2 bigint, similarity double"


def brute(data):
    groups = {}
    for tid, pid, a, b, s in data:
        if None in (a, b, s) or a == b or s != s:
            continue
        key = (min(a, b), max(a, b))
        of = groups.setdefault((tid, pid), {})
        of[key] = max(s, of.get(key, s))
    out = []
    for (tid, pid), of in groups.items():
        order = sorted((s, *k) for k, s in of.items())
        _, a, b = order[(len(order) + 1) // 2 - 1]
        out.append((tid, pid, a, b))
    return sorted(out, key=repr)


def test_middle_pairs_by_histograms(spark, work):
    rnd = random.Random(3)
    data = [("hot", 1, rnd.randrange(500), rnd.randrange(500), rnd.choice([0.5, 0.5001, 0.9, 1.0, 1.0])) for _ in range(4000)]
    data += [(rnd.choice(["a", None]), rnd.choice([1, 2, None]), rnd.randrange(40), rnd.randrange(40), round(rnd.random(), 4)) for _ in range(300)]
    data += [("a", 1, None, 2, 0.5), ("a", 1, 2, 3, None), ("a", 1, 2, 3, float("nan")), ("x", 9, 4, 4, 1.0)]
    once = {}
    for t, p, a, b, s in data:  # the same pair always has one similarity
        if None not in (a, b, s):
            once.setdefault((t, p, min(a, b), max(a, b)), s)
    data = [(t, p, a, b, once.get((t, p, min(a, b), max(a, b)), s) if None not in (a, b, s) else s) for t, p, a, b, s in data]
    df = spark.createDataFrame(data, DDL).repartition(4)
    assert rows(skew.middle_pairs(df, work, sortable=5)) == brute(data)
    assert rows(skew.middle_pairs(df, work)) == brute(data)


def test_all_ties_in_one_hot_key(spark, work):
    data = [("t", 1, i, 10_000 + j, 1.0) for i in range(40) for j in range(40)]
    assert rows(skew.middle_pairs(spark.createDataFrame(data, DDL), work, sortable=3)) == brute(data)


def test_empty_and_extra_columns(spark, work):
    assert rows(skew.middle_pairs(spark.createDataFrame([], DDL), work)) == []
    df = spark.createDataFrame([("t", 1, 1, 2, 0.5, 7, "x")], DDL + ", __n bigint, level string")
    assert rows(skew.middle_pairs(df, work)) == [("t", 1, 1, 2)]


def test_profile_and_latest(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 1, None), (None, None, 1.0)], "tid string, pid bigint, similarity double")
    assert rows(skew.key_profile(df)) == sorted([("t", 1, 2, 1, 0.5, 0.5, 0.5), (None, None, 1, 1, 1.0, 1.0, 1.0)], key=repr)
    subs = spark.createDataFrame([("d", "t", 1, 1, 5), ("d", "t", 1, 1, 9), ("d", "t", 1, 1, 9), ("d", "t", None, 1, 2)], "domain_id string, tid string, uid bigint, pid bigint, rid bigint")
    assert rows(latest.latest_submissions(subs)) == sorted([("d", "t", 1, 1, 9), ("d", "t", None, 1, 2)], key=repr)


def test_salted_join_matches_plain_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 99), ("z", 1)], "k string, i int")
    right = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, w double")
    out = rows(skew.salted_join(left, right, ["k"], ["i"], "left"))
    assert out == sorted([("a", i, 1.0) for i in range(50)] + [(None, 99, 2.0), ("z", 1, None)], key=repr)
    assert skew.hot_values(left, "k", 10) == ["a"]


def test_source_text(spark):
    subs = spark.createDataFrame([(1, "x", None), (2, "x", "b1#a.c"), (3, "y", "zz#b"), (4, None, None), (5, "q", "")], "rid bigint, code string, files_code string")
    blobs = spark.createDataFrame([("b1", bytearray(b"int"))], "id string, content binary")
    assert [(r["rid"], r["source"]) for r in latest.source_text(subs, blobs).orderBy("rid").collect()] == [(1, "x"), (2, "int"), (3, ""), (4, ""), (5, "q")]
