"""Shared spans and term weights against brute force."""

import math
import random

import pytest

from kinprint.llm import spans, terms
from tests.conftest import rows


def brute_spans(data, w):
    data = {r: [x % 2**32 for x in s if x is not None] for r, s in data if s}
    seen = {}
    for r, s in data.items():
        for i in range(len(s) - w + 1):
            seen.setdefault(tuple(s[i : i + w]), set()).add(r)
    out = []
    for r, s in data.items():
        cover = [False] * len(s)
        for i in range(len(s) - w + 1):
            if len(seen[tuple(s[i : i + w])]) > 1:
                cover[i : i + w] = [True] * w
        i = 0
        while i < len(s):
            if cover[i]:
                j = i
                while j < len(s) and cover[j]:
                    j += 1
                out.append((r, i, j))
                i = j
            else:
                i += 1
    return sorted(out, key=repr)


def sequences(seed, words=6, n=40):
    rnd = random.Random(seed)
    pool = [rnd.randrange(2**32) for _ in range(words)]
    parts = [[rnd.choice(pool) for _ in range(rnd.randrange(20, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        s = []
        for _ in range(rnd.randrange(4)):
            s += rnd.choice(parts) if rnd.random() < 0.6 else [rnd.choice(pool) for _ in range(rnd.randrange(50))]
        out.append((i, s))
    return out


@pytest.mark.parametrize("large", [500_000, 10])
@pytest.mark.parametrize("seed,words", [(1, 6), (2, 2), (3, 300)])
def test_shared_spans(spark, work, seed, words, large):
    data = sequences(seed, words)
    data += [(100, [7] * 3000), (101, [7] * 40), (102, None), (103, []), (104, [1, 2, 3]), (0, data[0][1]), (105, [None, *[x - 2**32 for x in data[5][1]]])]
    df = spark.createDataFrame(data, "rid bigint, seq array<bigint>").repartition(3)
    want = brute_spans([(r, s) for r, s in dict(data).items()], 32)
    assert rows(spans.shared_spans(df, work, large=large)) == want
    assert rows(spans.shared_spans(df, work, window=16, mmer=5, large=large)) == brute_spans(list(dict(data).items()), 16)


def test_shares_and_empty(spark, work):
    df = spark.createDataFrame([(1, [5] * 40), (2, [5] * 50), (3, None), (4, list(range(40)))], "rid bigint, seq array<bigint>")
    got = {r["rid"]: (r["n_values"], r["n_shared"], r["share"]) for r in spans.shared_shares(df, spans.shared_spans(df, work)).collect()}
    assert got == {1: (40, 40, 1.0), 2: (50, 50, 1.0), 3: (0, 0, 0.0), 4: (40, 0, 0.0)}
    assert spans.shared_spans(df.limit(0), work).count() == 0


def test_terms(spark, work):
    data = [(1, {"for": 3, "if": 1, "x": 0}), (2, {"for": 1, "asm": 1, "y": None}), (3, {"for": 2, "if": 2}), (4, {}), (5, None), (1, {"for": 3, "if": 1, "x": 0}), (None, {"for": 1})]
    df = spark.createDataFrame(data, "rid bigint, tf map<string,int>")
    n = 5
    tf = {1: {"for": 3, "if": 1}, 2: {"for": 1, "asm": 1}, 3: {"for": 2, "if": 2}}
    df_ = {"for": 3, "if": 2, "asm": 1}
    got = {(r["rid"], r["term"]): r["score"] for r in terms.scored_terms(df, work, "tf_idf").collect()}
    assert got == pytest.approx({(r, t): c * math.log(1 + n / df_[t]) for r, m in tf.items() for t, c in m.items()})
    assert [(r["rid"], r["term"]) for r in terms.top_term(terms.scored_terms(df, work, "tf_idf")).orderBy("rid").collect()] == [(1, "for"), (2, "asm"), (3, "if")]
    entropy = {}
    for t in df_:
        total = sum(m.get(t, 0) for m in tf.values())
        entropy[t] = 1 + sum(m[t] / total * math.log(m[t] / total) for m in tf.values() if t in m) / math.log(n)
    got = {(r["rid"], r["term"]): r["score"] for r in terms.scored_terms(df, work).collect()}
    assert got == pytest.approx({(r, t): math.log(1 + c) * entropy[t] for r, m in tf.items() for t, c in m.items()})


def test_terms_ties_and_empty(spark, work):
    df = spark.createDataFrame([(1, {"b": 1, "a": 1, "B": 1})], "rid bigint, tf map<string,int>")
    assert terms.top_term(terms.scored_terms(df, work)).first()["term"] == "B"
    assert terms.top_term(terms.scored_terms(df.limit(0), work)).count() == 0
