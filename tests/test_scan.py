import pytest
from pyspark.sql import functions as F

from kinprint.functions.artifacts import artifacts
from kinprint.operators import simjoin
from kinprint.plans import report, scan
from kinprint.plans.scan import ScanConfig
from kinprint.sources import store
from tests.conftest import rows

DDL = "domain_id string, tid string, rid bigint, uid bigint, pid bigint, lang string, code string, files_code string"
A = """#include <cstdio>
int best(int n, int width) { int total = 0; for (int i = 0; i < n; i++) { if (i % 2) total += width * i; else total -= i; } return total; }
// shared remark about the sum
int main() { int n, width; scanf("%d %d", &n, &width); while (n > 0) { printf("%d", best(n, width)); n--; } return 0; }"""
B = A.replace("best", "calc").replace("total", "acc").replace("width", "span").replace("int main() {", 'int main() { freopen("a", "r", stdin);')
C = """int f(int a) { return a ? f(a - 1) + 1 : 0; } int main() { char s[100]; gets(s); do { s[0]++; } while (s[0] < 'z'); switch (s[1]) { case 1: break; default: f(3); } return 0; }"""


def submissions(spark, data):
    return spark.createDataFrame([("d", "t", *r, None) for r in data], DDL)


def brute(data, k=8, t=0.55):
    docs = {r[0]: artifacts(r[4], r[3], k) for r in data}
    out = set()
    for i, x in enumerate(data):
        for y in data[i + 1 :]:
            if x[2] != y[2] or x[1] == y[1]:
                continue
            a, b = docs[x[0]], docs[y[0]]
            sa, sb = set(a["hashes"]), set(b["hashes"])
            sim = 1.0 if a["code_hash"] == b["code_hash"] else 2 * len(sa & sb) / (len(sa) + len(sb)) if sa and sb else 0
            if sim >= t:
                out.add((min((x[1], x[0]), (y[1], y[0]))[1], max((x[1], x[0]), (y[1], y[0]))[1]))
    return out


def test_trio_and_groups(spark, work):
    data = [(1, 10, 1, "cc.cc17", A), (2, 20, 1, "cc.cc17", B), (3, 30, 1, "cc.cc17", C), (4, 40, 1, "cc.cc17", A.replace("width", "other")), (5, 10, 1, "cc.cc17", A), (6, 50, 2, "cc.cc17", A)]
    pairs, docs, state = scan.scan(submissions(spark, data), None, work)
    got = {(r["rid1"], r["rid2"]): r for r in pairs.collect()}
    latest = [r for r in data if r[0] != 1]
    assert set(got) == brute(latest)
    renamed = got[(5, 4)] if (5, 4) in got else got[(4, 5)]
    assert renamed["similarity"] == 1.0 and renamed["level"] in (2, 3) and renamed["common"] == docs.where("rid = 5").first()["token_count"]
    copy = got[(5, 2)] if (5, 2) in got else got[(2, 5)]
    assert copy["shared_comments"] == 1 and copy["flags2" if copy["rid2"] == 2 else "flags1"] == ["freopen"] and copy["level"] >= 1
    assert all(r["uid1"] < r["uid2"] for r in got.values())
    stats = scan.report_stats(docs, pairs, state).first()
    assert (stats["users"], stats["submissions"], stats["pairs"], stats["skipped"]) == (5, 5, len(got), 0)


def test_empty_programs_pair_and_skips(spark, work):
    data = [(1, 1, 1, "c", "// a"), (2, 2, 1, "c", "/* b */"), (3, 3, 1, "c", ""), (4, 4, 1, "c", "x" * 2000), (5, 5, 1, None, None)]
    pairs, docs, state = scan.scan(submissions(spark, data), None, work, ScanConfig(max_code_size=1024))
    assert [(r["rid1"], r["rid2"], r["similarity"], r["level"]) for r in pairs.collect()] == [(1, 2, 1.0, 2)]
    s = scan.report_stats(docs, pairs, state).first()
    assert (s["skipped_empty"], s["skipped_big"], s["submissions"]) == (2, 1, 2)


def test_saturated_problem(spark, work):
    data = [(i, i, 1, "c", A.replace("n--;", "n--;" + " n++;" * i)) for i in range(1, 8)]
    _, _, state = scan.scan(submissions(spark, data), None, work)
    assert [r["trivial"] for r in state.collect()] == [True]


def test_modes_cache_and_exclusion(spark, work):
    data = [(1, 10, 1, "c", A), (2, 10, 1, "c", B), (3, 20, 1, "c", A), (4, 30, 2, "c", A), (5, 40, 2, "c", A)]
    subs = submissions(spark, data)
    every = scan.scan(subs, None, work, ScanConfig(mode="all"))[0]
    assert {(r["rid1"], r["rid2"]) for r in every.collect()} == {(1, 3), (2, 3), (4, 5)}
    few = scan.scan(subs, None, work, ScanConfig(mode="all", max_pairs=1))[0].collect()
    assert len(few) == 1 and few[0]["similarity"] == max(r["similarity"] for r in every.collect())
    less = scan.scan(subs, None, work, ScanConfig(exclude_pids=(2,)))
    assert less[1].select("pid").distinct().collect()[0][0] == 1
    feats = less[1].select("rid", F.lit("d").alias("domain_id"), "lang", F.lit(8).alias("k"), F.lit(3).alias("schema_version"), *scan.FEATURES)
    again = scan.scan(subs, feats, work, ScanConfig(exclude_pids=(2,)))
    assert again[1].where("hit").count() == 2 and rows(again[0]) == rows(less[0])


def test_no_submissions(spark, work):
    pairs, docs, state = scan.scan(submissions(spark, []), None, work)
    assert pairs.count() == 0 and scan.report_stats(docs, pairs, state).count() == 0


@pytest.mark.parametrize("hist,median", [({60: 1, 80: 3, 90: 1}, 0.80), ({70: 1, 80: 1, 90: 1, 100: 1}, 0.85), ({100: 25}, 1.0)])
def test_medians(spark, hist, median):
    df = spark.createDataFrame([("d", "t", 1, b, n) for b, n in hist.items()], "domain_id string, tid string, pid bigint, bucket int, n bigint")
    assert simjoin.medians(df).first()["median"] == median


@pytest.mark.parametrize("dense,block", [(0, 5000), (10**9, 5000), (0, 3), (10**9, 3)])
def test_joins_by_threshold_are_exact(spark, monkeypatch, dense, block):
    """Counted or filtered, cut into blocks or not: the same pairs, those of brute force."""
    import random

    monkeypatch.setattr(simjoin, "BLOCK", block)

    rnd = random.Random(1)
    base = [rnd.sample(range(60), 20) for _ in range(4)]
    sets = [sorted(set(rnd.choice(base)[: rnd.randrange(8, 20)] + rnd.sample(range(60), rnd.randrange(6)))) for _ in range(60)]
    df = spark.createDataFrame([("d", "t", i % 2, i, s) for i, s in enumerate(sets)], "domain_id string, tid string, pid bigint, rep bigint, fps array<bigint>")
    met = {(i, j): len(set(sets[i]) & set(sets[j])) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and set(sets[i]) & set(sets[j])}
    assert rows(simjoin.overlapping_pairs(df).select("rep1", "rep2", "common")) == sorted(((*k, n) for k, n in met.items()), key=repr)
    for t in (0.3, 0.75, 1.0):
        full = [(i, j, n) for (i, j), n in met.items() if 2 * n / (len(sets[i]) + len(sets[j])) >= t]
        assert rows(simjoin.pairs_at_least(df, t, dense=dense).select("rep1", "rep2", "common")) == sorted(full, key=repr)


def test_cap_with_nulls(spark, work, tmp_path):
    import __spark_entry__ as e

    ddl = "tid string, pid bigint, uid1 bigint, uid2 bigint, rid1 bigint, rid2 bigint, similarity double"
    best, twin, no_rid, nan, null = ("t", 1, 1, 2, 1, 2, 0.9), ("t", None, 1, 2, 1, 3, 0.9), ("t", 1, 1, 2, None, 4, 0.5), ("t", 1, 1, 2, 1, 5, float("nan")), ("t", 1, None, 2, 1, 6, None)
    order, other = [twin, best, no_rid, nan, null], (None, 1, 1, 2, 1, 2, None)
    pairs = spark.createDataFrame([*order[::-1], other], ddl)
    for most in range(1, 7):
        assert rows(report.capped(pairs, ["tid"], most, work).na.fill(-1.0, ["similarity"])) == rows(spark.createDataFrame([*order[:most], other], ddl).na.fill(-1.0, ["similarity"]))
    folder = str(tmp_path)
    more = [("t", 1, 1, 2, 1, 2, 0.8), ("t", 1, 7, 2, None, 4, 0.5)]  # an older row of a pair; another pair without a rid
    pairs.unionByName(spark.createDataFrame(more, ddl)).write.parquet(folder + "/pairs.parquet")
    got = e.queries()["pair_report"](spark, folder)
    assert got.count() == 7 and got.where("similarity = 0.8").count() == 0 and got.where("rid1 is null").count() == 2


def test_reports(spark, work, tmp_path):
    ddl = "domain_id string, tid string, pid bigint, uid1 bigint, uid2 bigint, rid1 bigint, rid2 bigint, similarity double, level int, sim_lex double, shared_comments int, flags1 array<string>, flags2 array<string>"
    pairs = spark.createDataFrame([("d", "t", 1, 10, 20, 1, 2, 0.99, 3, 0.8, 1, ["freopen"], None), ("d", "t", 2, 30, 10, 3, 1, 0.8, 2, None, 0, ["fork"], None), ("d", "u", 1, 30, 40, 5, 6, 0.6, 1, 0.2, 0, None, None)], ddl)
    s = {r["uid"]: r for r in report.user_summary(pairs).collect()}
    assert (s[10]["total"], s[10]["l3"], s[10]["l2"], s[10]["max_similarity"], s[10]["flags"], s[10]["comment_pairs"]) == (2, 1, 1, 0.99, ["freopen"], 1)
    assert [(r["pid"], r["partners"]) for r in report.user_problem(pairs).where("uid = 10").orderBy("pid").collect()] == [(1, 1), (2, 1)]
    assert report.pair_filter(pairs, 9).count() == 1 and report.pair_filter(pairs, user=30).count() == 2 and report.pair_filter(pairs, metric="lex").count() == 1
    assert [r["pid"] for r in report.page(pairs).collect()] == [1, 2, 1]
    assert report.capped(pairs, ["tid"], 1, work).select("rid1").orderBy("rid1").collect() == [(1,), (5,)]
    titles = spark.createDataFrame([(1, "One"), (2, "")], "pid bigint, title string")
    edges = report.graph_edges(pairs, titles, 2)
    assert {r["title"] for r in edges.collect()} == {"One", "P2"}
    nodes = {r["uid"]: r for r in report.graph_nodes(edges, spark.createDataFrame([(10, "ann")], "uid bigint, name string")).collect()}
    assert nodes[10]["degree"] == 2 and nodes[10]["name"] == "ann" and nodes[20]["name"] == "U20"
    assert [r["rid1"] for r in report.strongest(pairs, 1).collect()] == [1] and report.graph_stats(pairs, 2).first()["users"] == 3 and report.visible_edges(edges, [0]).count() == 2 and report.visible_edges(edges, [3]).count() == 1

    root = str(tmp_path / "pairs")
    store.replace_pairs(pairs, root, pairs.select("domain_id", "tid"))
    store.replace_pairs(pairs.where("tid = 'u'"), root, pairs.select("domain_id", "tid"))
    assert [r["tid"] for r in store.read_pairs(spark, root).select("tid").distinct().collect()] == ["u"]
    assert store.drop_partition(spark, root, "d") and not store.drop_partition(spark, root, "d")


def test_upsert_keeps_the_highest_version(spark):
    ddl = "rid bigint, schema_version int, x string, tf map<string,int>"
    old = spark.createDataFrame([(1, 3, "a", None), (2, 4, "b", {"if": 1}), (3, None, "c", None), (4, 3, "d", None), (4, 2, "e", None), (None, 3, "z", None)], ddl)
    new = spark.createDataFrame([(2, 3, "n", None), (3, 1, "n", None), (4, 3, "n", {"for": 2}), (5, 2, "low", None), (5, 3, "high", None), (None, 9, "z", None)], ddl)
    out = store.upsert_features(old, new)
    assert out.columns == ["rid", "schema_version", "x", "tf"]
    assert rows(out.select("rid", "schema_version", "x")) == [(1, 3, "a"), (2, 4, "b"), (3, 1, "n"), (4, 3, "n"), (5, 3, "high")]
    assert rows(store.upsert_features(None, new).select("rid", "x")) == [(2, "n"), (3, "n"), (4, "n"), (5, "high")]


def test_partitions_of_odd_names(spark, tmp_path):
    root = str(tmp_path / "odd")
    keys = [("d=1/x", "a b:c"), ("d=1/x", None), (None, "t"), ("e", "50%")]
    pairs = spark.createDataFrame([(*k, 1, 2, 1, 0.5) for k in keys], "domain_id string, tid string, rid1 bigint, rid2 bigint, level int, similarity double")
    every = pairs.select("domain_id", "tid")
    store.replace_pairs(pairs, root, every)
    assert store.read_pairs(spark, root).count() == 4
    store.replace_pairs(pairs.where("tid = 't'"), root, every.where("tid is null or tid <> '50%'"))
    assert rows(store.read_pairs(spark, root).select("domain_id", "tid")) == [("e", "50%"), (None, "t")]
    assert store.drop_contest(spark, [root, str(tmp_path / "none")], None, "t") == [True, False]
    assert store.drop_domain(spark, [root], "e") == [True] and store.drop_domain(spark, [root], "e") == [False]


def test_diffs(spark):
    df = spark.createDataFrame([(1, 2, "a\r\nb", "a\nx\n" + "y" * 600)], "rid1 bigint, rid2 bigint, l string, r string")
    assert [r["type"] for r in report.line_diffs(df, "l", "r", ["rid1", "rid2"]).orderBy("row").collect()] == ["eq", "del", "ins", "ins"]
    side = report.side_by_side(df, "l", "r", ["rid1", "rid2"]).orderBy("row").collect()
    assert side[2]["left_line"] is None and len(side[2]["right_line"]) == 501


def test_engine(spark, tmp_path):
    from kinprint.engine import Engine, register

    data = [(1, 10, 1, "c", A), (2, 20, 1, "c", B)]
    contests = spark.createDataFrame([("d", "t", "x", "acm", "2024-01-02 00:00:00"), ("d", "h", "y", "homework", "2024-01-03 00:00:00"), ("d", "n", None, None, None)], "domain_id string, tid string, title string, rule string, end_at string")
    contests = contests.withColumn("end_at", F.col("end_at").cast("timestamp_ntz")).withColumn("begin_at", F.col("end_at"))
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    reports = spark.createDataFrame([("r1", "d", "t", "failed", "2024-01-02 01:00:00", "2024-01-02 02:00:00", "e", None), ("r2", "d", "h", "done", "2024-01-03 01:00:00", None, None, None)], "id string, domain_id string, tid string, status string, created_at string, finished_at string, error string, last_error string")
    reports = reports.select("id", "domain_id", "tid", "status", stamp("created_at"), stamp("finished_at"), "error", "last_error")
    subs = submissions(spark, data)
    none = spark.createDataFrame([], "rid bigint, domain_id string, lang string, k int, schema_version int, code_hash string, token_count int, hashes array<bigint>, base_hashes array<bigint>, lex_base_hashes array<bigint>, tf map<string,int>, struct_vec array<double>, funcs array<struct<name:string,len:int,hash:bigint>>, idents array<string>, comment_hashes array<bigint>, flags array<string>")
    e = Engine(spark, submissions=subs, features=none, contests=contests, reports=reports)
    assert [r["tid"] for r in e.contests("contest").collect()] == ["t", "n"] and [r["tid"] for r in e.contests("homework").collect()] == ["h"]
    assert e.reports().count() == 2 and [(r["id"], r["minutes"]) for r in e.queue("2024-01-02 01:30:59").collect()] == [("r1", 30)]
    assert [r["tid"] for r in e.due("2024-01-05 00:00:00").collect()] == ["t"] and e.due("2024-01-02 02:30:00").count() == 0
    assert e.diagnostics().first()["total"] == 2
    got = e.scan(tid="t")
    assert got.pairs(page=1).count() == 1 and got.stats().first()["pairs"] == 1 and got.users().count() == 2 and got.user_problems().count() == 2
    nodes, edges, counts = got.graph(spark.createDataFrame([(1, "One")], "pid bigint, title string"), spark.createDataFrame([], "uid bigint, name string"))
    assert nodes.count() == 2 and edges.count() == 1 and counts.first()["total"] == 1
    assert got.diff(1, 2).where("type = 'eq'").count() >= 1 and got.diff(1, 2, beside=True).count() == len(A.split("\n"))
    got.save(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and e.scan(tid="none").pairs().count() == 0
    register(spark)
    row = spark.sql("select language_family('py3') a, token_text('int x;', 'c') b, fnv32a('main') c, seq_similarity(array(1L), array(1L)) d").first()
    assert tuple(row) == ("python", "int\nV\n;", 3935363592, 1.0)
