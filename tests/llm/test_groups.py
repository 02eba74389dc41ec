"""Connected components, similarity joins and near-copy groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinprint.llm import buckets, components, neardup, setjoin
from kinprint.llm import sketches as sk
from tests.conftest import rows

SETS = "id bigint, elems array<bigint>"


def union_find(edges):
    p = {}

    def root(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(p)}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(70)], [(i + 1, i) for i in range(60, 0, -1)] + [(1000, 999)], [(5, i) for i in range(40)] + [(100, i) for i in range(100, 140)], [(a, b) for a in range(8) for b in range(8)]])
def test_components(spark, work, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {v: l for v, l in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert dict(rows(components.connected_components(df, work))) == want
    assert dict(rows(components.connected_components(df, work, hot=3))) == want  # hubs salted


def test_random_components(spark, work):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert dict(rows(components.connected_components(df, work, hot=2))) == union_find([e for e in edges if e[0] != e[1]])


def test_pair_groups_with_nulls_and_loops(spark, work):
    ddl = "rid1 bigint, rid2 bigint, uid1 bigint, uid2 bigint, v string, p int"
    df = spark.createDataFrame([(1, 2, 10, None, "x", 0), (3, None, 10, 11, "x", 0), (2, 4, None, None, "x", 0), (5, 5, 12, 12, "x", 0), (2, 1, 13, 10, "x", 0)], ddl)
    got = rows(components.pair_groups(df, work))
    assert got == sorted([("rid", 1, 1), ("rid", 2, 1), ("rid", 4, 1), ("rid", 3, 3), ("rid", 5, 5), ("uid", 10, 10), ("uid", 11, 10), ("uid", 13, 10), ("uid", 12, 12)], key=repr)
    assert components.pair_groups(df.limit(0), work).count() == 0


def families(rnd, n, size, edits, universe=4_000_000_000):
    out = []
    for _ in range(n):
        base = rnd.sample(range(universe), size)
        out.append(base)
        for _ in range(rnd.randrange(3)):
            other = list(base)
            for i in rnd.sample(range(size), rnd.randrange(edits)):
                other[i] = rnd.randrange(universe)
            out.append(other)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def links(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= t}


def test_similar_within_finds_the_pairs(spark, work):
    rnd = random.Random(11)
    data = list(enumerate(families(rnd, 120, 60, 12)))
    data += [(1000, data[0][1][::-1] * 2), (1001, [x - 2**32 for x in data[0][1]]), (1002, []), (1003, None), (1004, [None]), (0, data[0][1])]
    sets = {i: {x % 2**32 for x in (e or []) if x is not None} for i, e in data}
    found, copies = setjoin.similar_within(spark.createDataFrame(data, SETS), 0.75, work)
    got = {tuple(r) for r in setjoin.expand_within(found, copies).collect()}
    want = links(sets, 0.75)
    assert got <= want and len(got) >= 0.98 * len(want) > 50
    assert {(0, 1000), (0, 1001), (1000, 1001)} <= got
    blocks, more = setjoin.similar_within(spark.createDataFrame(data, SETS), 0.75, work, cap=2)
    assert {tuple(r) for r in setjoin.expand_within(blocks, more).collect()} == got  # cut buckets lose nothing


def test_similar_between(spark, work):
    rnd = random.Random(12)
    known = [(i, s) for i, s in enumerate(families(rnd, 15, 200, 1))]
    rows_ = []
    for i, s in known:
        for _ in range(3):
            keep = rnd.sample(s, rnd.randrange(100, 200))
            rows_.append((100 + len(rows_), keep + [rnd.randrange(2**32) for _ in range(rnd.randrange(60))]))
    rows_ += [(900, rows_[0][1]), (901, None)]
    want = {(a, b) for a, x in known for b, y in rows_ if y and jaccard(set(x), set(y)) >= 0.5}
    found, q, s = setjoin.similar_between(spark.createDataFrame(known, SETS), spark.createDataFrame(rows_, SETS), 0.5, work)
    got = {tuple(r) for r in setjoin.expand_between(found, q, s).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 30


def test_known_solutions_as_classes_and_counts(spark, tmp_path):
    from kinprint.llm import queries

    a, b = list(range(100)), list(range(1000, 1100))
    known = [(1, a), (2, a[::-1]), (3, b), (4, list(range(5000, 5100))), (5, []), (None, a)]
    found = [(10, a), (11, a), (12, a[:80]), (13, b[:60] + a[:5]), (14, list(range(9000, 9100))), (15, None), (10, a)]
    spark.createDataFrame(known, "ref_id bigint, hashes array<bigint>").write.parquet(str(tmp_path / "known_solutions.parquet"))
    counted = [(r, h, 50, 8, 3) for r, h in found] + [(16, a, 39, 8, 3), (17, a, 50, 7, 3)]
    spark.createDataFrame(counted, "rid bigint, hashes array<bigint>, token_count int, k int, schema_version int").write.parquet(str(tmp_path / "features.parquet"))
    got = rows(queries.QUERIES["p3_known"](spark, str(tmp_path)))
    assert got == [("known", 1, 1, 2), ("known", 2, 1, 2), ("known", 3, 3, 1), ("known", 4, 4, 0), ("known", 5, 5, 0)] + [("row", 10, 10, 1), ("row", 11, 10, 1), ("row", 12, 12, 1), ("row", 13, 13, 1), ("row", 14, 14, 0), ("row", 15, 15, 0)]


def test_empty_joins(spark, work):
    none = spark.createDataFrame([], SETS)
    found, copies = setjoin.similar_within(none, 0.75, work)
    assert setjoin.expand_within(found, copies).count() == 0
    assert setjoin.expand_between(*setjoin.similar_between(none, none, 0.5, work)).count() == 0
    assert neardup.near_copy_groups(none, 0.75, work).count() == 0


@pytest.mark.parametrize("cap", [20_000, 3])
def test_near_copy_groups(spark, work, cap):
    rnd = random.Random(13)
    data = list(enumerate(families(rnd, 60, 90, 20)))
    chain = rnd.sample(range(2**32), 100)
    for i in range(6):  # each near the next, the ends far apart
        chain = chain[:]
        for j in rnd.sample(range(100), 12):
            chain[j] = rnd.randrange(2**32)
        data.append((500 + i, chain))
    data += [(700 + i, data[0][1]) for i in range(30)] + [(800, []), (801, None)]
    sets = {i: set(e) for i, e in data if e}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(sets[a] & sets[b]) >= 0.75 * (len(sets[a]) + len(sets[b]))]
    got = dict(rows(neardup.near_copy_groups(spark.createDataFrame(data, SETS), 0.75, work, cap=cap)))
    assert got == union_find(edges)


def test_sketches_estimate_jaccard():
    rnd = np.random.default_rng(1)
    for n, j, m in ((80, 0.75, 512), (300, 0.5, 256)):
        common = round(2 * n * j / (1 + j))
        sets = []
        for _ in range(60):
            base = rnd.integers(0, 2**32, 2 * n - common, dtype=np.uint64)
            sets += [np.sort(base[:n]), np.sort(base[n - common :])]
        offsets, values = np.cumsum([0] + [len(s) for s in sets]), np.concatenate(sets)
        bits = sk.one_bit_minhashes(values, offsets, m)
        assert abs((bits[::2] == bits[1::2]).mean() - (1 + j) / 2) < 0.02
        sig = sk.super_minhash(values, offsets, 128)
        assert abs((sig[::2] == sig[1::2]).mean() - j) < 0.03


def test_super_minhash_is_one_permutation_an_element():
    one = sk.super_minhash(np.array([7], dtype=np.uint64), np.array([0, 1]), 64)[0] >> np.uint64(53)
    assert sorted(one.tolist()) == list(range(64))
    empty = sk.super_minhash(np.zeros(0, dtype=np.uint64), np.array([0, 0]), 8)
    assert (empty == np.iinfo(np.uint64).max).all()


def test_ragged_sets_and_digests():
    column = pa.array([[3, 1, 3, None, 1 - 2**32], None, [], [2**32 + 5]], pa.list_(pa.int64()))
    values, offsets = sk.ragged_sets(column)
    assert values.tolist() == [1, 3, 5] and offsets.tolist() == [0, 2, 2, 2, 3]
    a, _ = sk.digests(values, offsets)
    assert a[1] == a[2] == 0 and a[0] != a[3]
    values, offsets = sk.ragged_sets(column.slice(3))
    assert values.tolist() == [5] and offsets.tolist() == [0, 1]


def test_plan_and_tail():
    assert sk.tail_radius(10, 0.5, 1.0 - 1e-9) == 10 and sk.segments_needed(1.0, 0.99) == 1
    small, large = setjoin.Plan(0.75, 1000), setjoin.Plan(0.75, 1_000_000)
    assert small.length < large.length and small.count < large.count and small.radius == large.radius


def test_near_pairs_kinds(spark):
    ddl = "key bigint, id bigint, size int, c0 bigint, c1 bigint, c2 bigint, tag bigint"
    data = [(1, i, 10, 0, 0, -1 if i == 3 else 0, i % 2) for i in range(6)] + [(2, 9, 10, 0, 0, 0, 0)]
    df = spark.createDataFrame(data, ddl)
    every = rows(buckets.near_pairs(df, 3, 0.5))
    assert len(every) == 10 and (3, 4) not in every
    assert rows(buckets.near_pairs(df, 3, 0.5, "sides")) == sorted((a, b) for a in (0, 2, 4) for b in (1, 5))
    assert rows(buckets.near_pairs(df, 3, 0.5, "labels", cap=2)) == rows(buckets.near_pairs(df, 3, 0.5, "labels"))
    assert len(rows(buckets.near_pairs(df, 200, 0.5, "next"))) <= 5


def test_local_roots_are_components():
    rnd = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 3), (50, 30), (200, 400)):
        a, b = rnd.integers(0, n, (2, m))
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b):
            p, q = sorted((root(x), root(y)))
            parent[q] = p
        got = dict(zip(*map(list, components.local_roots(a, b))))
        assert got == {x: root(x) for x in {*a, *b} if root(x) != x}


def test_copies_and_links_salted(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HUB", 2)
    monkeypatch.setattr(setjoin, "COPIES", 2)
    links = [(1, k) for k in range(10, 16)] + [(2, 30), (3, 30)]
    copies = [(1, 1), (101, 1), (102, 1), (103, 1), (30, 30), (130, 30), (11, 11), (111, 11)]
    of = {r: [i for i, q in copies if q == r] for _, r in copies}
    want = {tuple(sorted((x, y))) for a, b in links for x in of.get(a, [a]) for y in of.get(b, [b])}
    want |= {(x, y) for ids in of.values() for x in ids for y in ids if x < y}
    got = setjoin.expand_within(spark.createDataFrame(links, "id1 bigint, id2 bigint"), spark.createDataFrame(copies, "id bigint, rep bigint"))
    assert rows(got) == sorted(want, key=repr)


def test_banding_keeps_recall():
    small, large = neardup.Banding(50_000, 0.6, 0.998), neardup.Banding(10**9, 0.6, 0.998)
    assert small.rows == 4 and large.rows == 8 and large.values == neardup.VALUES and len(large.chosen) > len(small.chosen)
    rnd = np.random.default_rng(1)
    agree = rnd.random((400, large.values)) < 0.6
    assert agree[:, large.chosen].all(axis=2).any(axis=1).mean() > 0.985


def test_recall_below_one():
    with pytest.raises(ValueError):
        setjoin.Plan(0.75, 1000, 1.0)
