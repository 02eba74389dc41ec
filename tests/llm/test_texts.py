"""Packing, mixing and text quality."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinprint.llm import mixing, packing, prose, quality, tokens
from tests.conftest import rows

VOCABULARY = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs the vocabulary file")


@given(st.lists(st.tuples(st.integers(1, 120), st.integers(0, 120)), max_size=80))
@settings(max_examples=100, deadline=None)
def test_pack_keeps_all_limits(items):
    sizes = np.array([(a, 1, min(a, b)) for a, b in items], dtype=np.int64).reshape(-1, 3)
    limits = np.array([100, 7, 95])
    where = packing.pack(sizes, limits)
    assert (where >= 0).all() if len(sizes) else len(where) == 0
    for c in set(where.tolist()):
        held = sizes[where == c]
        assert len(held) == 1 or (held.sum(axis=0) <= limits).all()


COUNTS = "doc_id bigint, n_tokens int, n_prompt int"


def test_packed_items(spark):
    data = [(i, 5 + i * 37 % 90, i % 5) for i in range(400)] + [(900, 257, 3), (901, 0, 0), (902, 100, 0), (902, 100, 0)]
    specs = spark.createDataFrame([(1, 100), (2, 64), (3, None), (None, 5), (4, -1)], "spec_id bigint, capacity_tokens int")
    out = packing.packed(spark.createDataFrame(data, COUNTS), specs, shard=150)
    for spec, capacity in ((1, 100), (2, 64)):
        mine = out.where(F.col("spec_id") == spec)
        got = mine.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
        counts = {r["doc_id"]: (r["n"], r["k"]) for r in got.collect()}
        assert 901 not in counts and counts[902][0] == 200
        for i, n, _ in data[:401]:
            assert counts[i] == (n, -(-n // capacity))  # split only above the capacity
        per = mine.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count(F.lit(1)).alias("k"))
        assert per.where((F.col("t") > capacity) | ((F.col("k") > 1) & ((F.col("k") > max(1, capacity // 16)) | (F.col("l") > int(capacity * 0.95))))).count() == 0
    assert {r["spec_id"] for r in out.select("spec_id").distinct().collect()} == {1, 2}
    report = {r["spec_id"]: r["used_share"] for r in packing.container_report(out, specs).collect()}
    assert report[1] > 0.9
    assert packing.packed(spark.createDataFrame([], COUNTS), specs).count() == 0
    assert packing.packed(spark.createDataFrame(data, COUNTS), specs.limit(0)).count() == 0


def test_too_many_settings_are_refused(spark, monkeypatch):
    specs = spark.range(1001).select(F.col("id").alias("spec_id"), (F.col("id") + 10).cast("int").alias("capacity_tokens"))
    counts = spark.createDataFrame([(1, 5, 0)], COUNTS)
    with pytest.raises(ValueError, match="pack_specs"):
        packing.pieces(counts, packing.with_limits(specs))
    assert packing.pieces(counts, packing.with_limits(specs.where("spec_id < 1000"))).count() == 1000
    items = spark.range(1001).selectExpr("id spec_id", "id container_id", "1 n_tokens")
    assert packing.container_report(items, specs).count() == 1001
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    available = spark.createDataFrame([("a", 900), ("b", 900)], "source string, tokens bigint")
    assert len(mixing.quotas(available, targets)) == 2
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError, match="mix_targets"):
        mixing.quotas(available, targets)


def highest_quotients(weights, seats, caps=None):
    held = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [n for n in weights if weights[n] > 0 and (caps is None or held[n] < caps.get(n, seats))]
        if not open_:
            break
        best = max(open_, key=lambda n: (weights[n] / (2 * held[n] + 1), [-ord(c) for c in n]))
        held[best] += 1
    return held


def highest_quotients_of(weights, seats, caps):
    held = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = min((n for n in weights if held[n] < caps[n]), key=lambda n: (-weights[n] / (2 * held[n] + 1), n))
        held[best] += 1
    return held


@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_sainte_lague_gives_the_highest_quotients(weights, seats):
    w = {f"s{i}": x / 100 for i, x in enumerate(weights)}
    assert mixing.sainte_lague(w, seats) == highest_quotients(w, seats)


def test_sainte_lague_with_caps():
    got = mixing.sainte_lague({"a": 0.5, "b": 0.3, "c": 0.2, "z": 0.0}, 100, {"a": 10, "b": 1000})
    assert got["a"] == 10 and sum(got.values()) == 100 and got["z"] == 0 and 52 <= got["b"] <= 56
    assert mixing.sainte_lague({"a": 1.0}, 50, {"a": 3}) == {"a": 3} and mixing.sainte_lague({}, 5) == {}


def test_mixture(spark, work):
    data = [(i, " Big " if i % 2 else "BIG", 100 + i % 7) for i in range(600)] + [(1000 + i, "small", 90) for i in range(12)] + [(2000, None, 5), (2001, "other", 5), (2002, "small", 0), (2003, "  ", 9)]
    counts = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    texts, report = mixing.mixture(counts, targets, work, shard=100)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"]["taken_tokens"] == 0
    assert got["big"]["reached_share"] == pytest.approx(0.8, abs=0.02) and got["small"]["reached_share"] == pytest.approx(0.2, abs=0.02)
    assert got["small"]["most_copies"] <= 3 and got["big"]["most_copies"] == 1
    assert texts.groupBy("doc_id").count().where("count > 1").count() == 0
    again, _ = mixing.mixture(counts.repartition(3), targets, work, shard=100)
    assert rows(texts) == rows(again)
    fixed = mixing.mixture(counts, targets, work, total_tokens=2000, shard=100)[1]
    assert 1500 < fixed.agg(F.sum("taken_tokens")).first()[0] < 2500
    none, empty = mixing.mixture(counts.limit(0), targets, work)
    assert none.count() == 0 and empty.agg(F.sum("taken_tokens")).first()[0] == 0


def test_shards_have_whole_blocks(spark):
    held = {"a": [630, 1, 200, 65, 5000], "b": [64, 64, 64], "c": [100]}
    stock = spark.createDataFrame([(s, i, n) for s, x in held.items() for i, n in enumerate(x)], "source string, shard int, held bigint")
    plan = spark.createDataFrame([("a", 64 * 40, 1), ("b", 64 * 7, 3), ("c", 64 * 3, 2), ("z", 0, 1)], "source string, quota bigint, cap int")
    got = {}
    for r in mixing.shard_blocks(stock, plan).collect():
        got.setdefault(r["source"], {})[r["shard"]] = r["blocks"]
    assert {s: sum(x.values()) for s, x in got.items()} == {"a": 40, "b": 7, "c": 3}
    for s, seats, cap in (("a", 40, 1), ("b", 7, 3), ("c", 3, 2)):
        assert got[s] == highest_quotients_of(dict(enumerate(held[s])), seats, {i: -(-n * cap // 64) for i, n in enumerate(held[s])})


def test_texts_go_with_their_blocks(spark, work):
    counts = spark.createDataFrame([(i, "s", 16) for i in range(40)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    # 90 tokens are one whole block of 64: four texts of 16; 64 * 13 of 640 tokens are one round of ten blocks and three more.
    for total, want in ((90, {1: 4}), (64 * 13 + 40, {1: 28, 2: 12}), (640 * 3, {3: 40})):
        texts = mixing.mixture(counts, targets, work, total_tokens=total)[0]
        assert {r["copies"]: r["count"] for r in texts.groupBy("copies").count().collect()} == want


@VOCABULARY
def test_token_counts(spark):
    enc = tokens.encoder()
    text = "Hello world, this is a test.\nSecond line <|endoftext|>."
    assert tokens.token_count(enc, text) == len(enc.encode_ordinary(text)) and enc.decode(enc.encode_ordinary(text)) == text
    for long in ("word " * 20_000, "#" * 50_000, "-" * 45_001, "a\n\n\n" * 15_000, "don't  stop\r\n 42\u00a0x " * 3000, " " * 30_000 + "x" * 30_000):
        assert tokens.token_count(enc, long) == len(enc.encode_ordinary(long))


def test_token_counts_across_cuts(monkeypatch):
    enc, rnd = tokens.encoder(), np.random.default_rng(3)
    monkeypatch.setattr(tokens, "_PIECE", 7)
    bits = ["a", "B", "9", " ", " ", "\n", "\r", "\t", "'", "'s", "é", "語", "-", "--", "\u00a0", "\u2003", "\x1c", "\x85"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits, rnd.integers(0, 60)))
        assert tokens.token_count(enc, text) == len(enc.encode_ordinary(text)), repr(text)


def test_prompt_tokens(spark):
    text = "Hello world, this is a test.\nSecond line <|endoftext|>."
    df = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", None), (4, "one line", "s")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_prompt"]) for r in tokens.with_token_counts(df).collect()}
    assert got[2] == got[3] == (0, 0) and got[4][1] == 0 and 0 < got[1][1] < got[1][0]


WORDS = [("en", w) for w in "the of and to a in is that it for was on are with as be this have from".split()] + [(" EN", "The "), ("de", "der"), ("de", "und"), ("de", "nicht"), ("de", "ist"), ("fr", None), (None, "x")]
SENTENCES = ["This is the text of a report that was sent to the office for a check.", "It was a long walk to the station and the train from the north was late.", "The price of the bread is on the list that is kept in the shop.", "A new bridge is to be built with the money that was set aside for this.", "For the last part of the trip it is good to have a map and a coat.", "There are some in the town that have not heard of it as of this day."]


def test_text_quality(spark, work):
    rnd = np.random.default_rng(4)
    say = lambda n: " ".join(SENTENCES[i] for i in rnd.integers(0, len(SENTENCES), n))
    listed = lambda n: "\n".join(f"- {a} {b}" for a, b in rnd.choice(["node", "route", "stone", "heap", "queue"], (n, 2)))
    code = "for (int i = 0; i < n; i++) {\n  sum_x2 += a[i] * b[i];\n}\n" * 6
    data = [(i, "en", say(int(rnd.integers(2, 9)))) for i in range(200)]
    data += [(300, "EN", listed(60)), (301, None, "a\tb\tc\n" + "12\t0.5\tWA\n" * 40), (302, "en", code), (303, "en", "#" * 5000), (304, "und", "x9 q_1 " * 800)]
    data += [(400, "en", say(6) + "\n" + listed(4)), (401, "en", say(1) + "\n" + listed(60)), (402, "en", say(3).lower().replace(".", "")), (403, "en", say(4).replace(" ", " ", 9).replace(". ", ".\r\n"))]
    data += [(500, "en", None), (501, None, " \n "), (502, "en", ""), (None, "en", listed(9))]
    docs = spark.createDataFrame([(*d, "x") for d in data], "doc_id bigint, lang string, text string, weight string")
    words = spark.createDataFrame(WORDS, "lang string, word string")
    out = quality.text_quality(docs, words, work).cache()
    assert sorted(r[0] for r in quality.not_prose(out).collect()) == [300, 301, 302, 303, 304, 401]
    assert out.where("doc_id >= 500 and n_chars = 0 and outlier_share is null").count() == 3
    row = out.where("doc_id = 300").first()
    parts = [row[f"{s}_part"] for s in prose.STATISTICS]
    assert sum(parts) == pytest.approx(row["distance"] ** 2) and row["distance"] ** 2 > quality.CUTOFF and row["bullet_share_part"] > 1
    assert {300, 301, 302, 303, 304} <= {r[0] for r in quality.far_from_prose(out).collect()} and out.where("doc_id < 200 and distance > 6").count() == 0
    assert quality.not_prose(quality.text_quality(docs.limit(0), words, work)).count() == 0


def test_statistics_are_the_whole_texts(spark, work):
    line = "The bread of the shop is good " * 13 + "now."
    lines = "the end of it.\r\n\r\nNo stop # here\n- 12 of that!"
    docs = spark.createDataFrame([(1, "en", line), (2, "en", lines), (3, "zh", "我是人。\n你也是"), (4, "en", " \n"), (5, "en", None)], "doc_id bigint, lang string, text string")
    got = {r["doc_id"]: r for r in quality.text_quality(docs, spark.createDataFrame(WORDS, "lang string, word string"), work).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["n_words"], one["n_lines"], one["end_share"]) == (92, 1, 1.0)  # one line of 394 characters, not two or three
    assert one["word_length"] == pytest.approx((13 * 23 + 3) / 92) and one["common_share"] == pytest.approx(13 * 4 / 92)
    assert one["variety"] == pytest.approx(7 / 92) and one["line_words"] == pytest.approx(np.log1p(92)) and one["symbol_share"] == 0
    assert (two["n_words"], two["n_lines"], two["n_chars"]) == (9, 3, 32)
    assert two["end_share"] == pytest.approx(2 / 3) and two["bullet_share"] == pytest.approx(1 / 3)
    assert two["symbol_share"] == pytest.approx(1 / 32) and two["digit_share"] == pytest.approx(2 / 32) and two["common_share"] == pytest.approx(5 / 9)
    assert (three["n_words"], three["n_lines"], three["word_length"], three["end_share"]) == (6, 2, 1.0, 0.5)
    for i in (4, 5):
        assert (got[i]["n_words"], got[i]["n_lines"], got[i]["n_chars"], got[i]["end_share"]) == (0, 0, 0, None)


def test_a_rare_language_has_no_threshold():
    rnd = np.random.default_rng(6)

    def moments(x):
        return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)))

    many, few = rnd.normal(0.5, 0.1, (4000, quality.D)), rnd.normal(0.9, 0.1, (60, quality.D))
    probe = np.full((1, quality.D), 1.2)
    d2 = []
    for n in range(61):
        model = quality.Model({"en": moments(many), **({"xx": moments(few[:n])} if n else {})}, np.full(quality.D, 0.1))
        d2.append(float(model.contributions(np.array(["xx"]), probe).sum()))
        if n:
            assert 0.5 < model.mean["xx"].mean() < 0.9
    assert max(abs(np.diff(d2))) < 0.25 * (max(d2) - min(d2)) and d2[60] < d2[0]
    assert len(quality.Model({}, np.zeros(quality.D)).mean) == 1


def test_distance_is_mahalanobis():
    rnd = np.random.default_rng(7)
    x = rnd.multivariate_normal(np.zeros(quality.D), np.eye(quality.D) + 0.5, 200_000)
    d2 = np.einsum("ij,jk,ik->i", x, np.linalg.inv(np.eye(quality.D) + 0.5), x)
    assert quality.chi_square(quality.CUTOFF, quality.D) == pytest.approx(quality.INSIDE) and (d2 < quality.CUTOFF).mean() == pytest.approx(quality.INSIDE, abs=0.002)
    inside = x[d2 < quality.CUTOFF]  # the trimmed covariance is brought back to scale
    assert quality.CONSISTENCY * np.cov(inside.T) == pytest.approx(np.eye(quality.D) + 0.5, abs=0.03)
    model = quality.Model({"en": quality._sums(inside)}, np.ones(quality.D))
    cov = (1 - quality.RIDGE) * quality.CONSISTENCY * np.cov(inside.T, bias=True) + quality.RIDGE * np.eye(quality.D)
    want = np.einsum("ij,jk,ik->i", x[:50] - inside.mean(0), np.linalg.inv(cov), x[:50] - inside.mean(0))
    assert model.contributions(np.array(["en"] * 50), x[:50]).sum(axis=1) == pytest.approx(want, rel=0.01)


@given(st.text(max_size=600))
@settings(max_examples=200, deadline=None)
def test_stretches_hold_every_character(text):
    cut, _ = prose.stretches(text)
    bare = lambda s: "".join(s.split())
    assert bare("".join(cut)) == bare(prose.clean(text))


@given(st.text(alphabet="ab the. \n#1_é人，\u00a0", max_size=900))
@settings(max_examples=200, deadline=None)
def test_whole_counts_are_those_of_the_text(text):
    common = prose.Common({"en": frozenset({"the"})})
    parts, whole, lang = prose.measured(text, None, common)
    if not parts:
        assert not text.strip()
        return
    once = prose.Counts(prose.clean(text), common)
    assert all(getattr(whole, c) == getattr(once, c) for c in prose.Counts.__slots__) and lang == once.language(common, None)
    assert len(whole.statistics(lang, common)) == len(prose.STATISTICS)


def test_languages():
    common = prose.Common({"en": frozenset({"the", "of"}), "de": frozenset({"der", "und"})})
    say = lambda text, declared: prose.Counts(text, common).language(common, declared)
    assert say("the end of the day", "de") == "en"
    assert say("x " * 9, " DE ") == "de" and prose.Counts("", prose.Common({})).language(prose.Common({}), None) == "und"
    assert say("这是一个测试", "en") == "zh"
