import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import dedup, links, ranking, reports, sessions, vectors
from sparkloom.operators.components import connected_components
from sparkloom.runtime import hot_keys, join_by_key


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {n: root(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_latest_first_union_and_upsert_rules(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", None, "z"), (None, 9, "n"), ("b", None, "only")], "k string, t int, v string")
    assert sorted(rows_of(dedup.latest_per_key(df, ["k"], [F.col("t")]), "k", "v"), key=str) == [("a", None), ("b", "only")]
    assert sorted(rows_of(dedup.first_per_key(df, ["k"], [F.asc_nulls_last("t")], 2), "k", "t"), key=str) == sorted([("a", 1), ("a", 3), (None, 9), ("b", None)], key=str)
    u = dedup.union_by_precedence([df.where("v = 'x'"), df.where("k = 'b'").drop("t"), df.where("v = 'z'")], ["k"])
    assert sorted(rows_of(u, "k", "v")) == [("a", "x"), ("b", "only")]
    c = dedup.cap_for_type(df, "v", "x", 0, [F.col("t")])
    assert c.count() == 4 and dedup.latest_per_key(df.where("false"), ["k"], [F.col("t")]).count() == 0


def fold(rows, suffixes=("de", "fr")):
    kept = {}
    for p, scope, name, score in rows:
        base = name.rsplit("-", 1)[0] if name.rsplit("-", 1)[-1] in suffixes and "-" in name else name
        key = (scope, base)
        if key not in kept or name == base or (score or 0) > (kept[key][3] or 0):
            kept[key] = (p, scope, name, score)
    return sorted(r[0] for r in kept.values())


def test_language_variants_equal_the_fold(spark):
    rng = random.Random(2)
    rows = [(p, rng.choice(["r", "s", None]), rng.choice(["x", "x-de", "x-fr", "y-de", "y"]), rng.choice([None, 1, 2, 3])) for p in range(300)]
    got = dedup.language_variants(spark.createDataFrame(rows, "p long, scope string, name string, score int"), F.col("scope"), "name", "score", "p")
    assert sorted(r["p"] for r in got.collect()) == fold(rows)


def test_absorb_takes_unknown_fields_in_order(spark):
    rows = [("k", 2, "b", "", "oauth", ["y"]), ("k", 1, "a", None, "unknown", ["x", "y"]), ("k", 3, "a", "text", "key", None), (None, 1, "c", None, None, None)]
    df = spark.createDataFrame(rows, "k string, p int, s string, d string, auth string, c array<string>")
    out = {r["k"]: r for r in dedup.absorb(df, "k", [F.col("p")], ["d", "auth"], ["c"], "s").collect()}
    assert (out["k"]["s"], out["k"]["d"], out["k"]["auth"], out["k"]["c"], out["k"]["also_listed_in"], out["k"]["merged"]) == ("a", "text", "oauth", ["x", "y"], ["b"], 3)
    assert out[None]["merged"] == 1


def test_states_fill_and_collisions(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, sha string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), (None, "x")], "id string, sha string")
    assert dict(rows_of(dedup.changed_rows(new, old, "id", "sha"), "id", "state")) == {"a": "unchanged", "b": "changed", "c": "changed"}
    assert dict(rows_of(dedup.fill_from(new, old, "id", ["sha"], True), "id", "sha")) == {"a": "1", "b": "9", "c": None}
    dup = spark.createDataFrame([("x", "s1"), ("x", "s2"), ("y", "s")], "id string, s string")
    assert sorted(rows_of(dedup.suffix_collisions(dup, "id", [F.col("s")], F.col("s")), "id")) == [("x",), ("x~s2",), ("y",)]


@pytest.mark.parametrize(("n", "cap", "want"), [(38, None, (3, 11, 24)), (10, None, (1, 3, 6)), (4500, None, (450, 1350, 2700)), (100, 15, (10, 5, 85)), (100, 4, (4, 0, 96)), (0, None, (0, 0, 0))])
def test_tiers(spark, n, cap, want):
    df = spark.range(n).select("id", (F.col("id") % 7).alias("score"))
    got = dict(rows_of(ranking.percentile_tiers(df, [F.desc("score"), F.asc("id")], cap=cap).groupBy("tier").count(), "tier", "count"))
    assert tuple(got.get(t, 0) for t in ("featured", "solid", "listed")) == want


def test_global_rank_round_robin_downsample_and_slugs(spark):
    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"))
    want = {i: k + 1 for k, (_, i) in enumerate(sorted(rows_of(df, "s", "id")))}
    assert dict(rows_of(ranking.global_rank(df, [F.col("s"), F.col("id")], partitions=7), "id", "rank")) == want
    rr = spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 5), ("c", 6)], "s string, v int")
    assert sorted(rows_of(ranking.round_robin(rr, "s", [F.desc("v")], 4), "v"), reverse=True) == [(9,), (8,), (6,), (5,)]
    for n in (1, 59, 60, 61, 84, 200):
        kept = {r[0] for r in rows_of(ranking.downsample(spark.range(n).withColumn("k", F.lit("k")), ["k"], [F.col("id")], 60), "id")}
        assert kept == (set(range(n)) if n <= 60 else {int(i * (n / 60.0) // 1) for i in range(60)} | {n - 1})
    sl = spark.createDataFrame([("1", "o", "long", "n", 5), ("2", "o", "r", "n", 5), ("3", "o", "r", "m", None)], "id string, o string, r string, n string, q int")
    out = {r["id"]: (r["slug"], r["winner"]) for r in ranking.slugs(sl, F.col("o"), "n", "r", "q", "id").collect()}
    assert out == {"1": ("o/long-n", False), "2": ("o/r-n", True), "3": ("o/m", False)}


def test_containment_co_occurrence_and_growth(spark):
    p = spark.createDataFrame([("P", "r", "a/b"), ("root", "r", ""), ("Q", "s", "a")], "id string, repo string, path string")
    ch = spark.createDataFrame([("1", "r", "a/b/c"), ("2", "r", "a/bc"), ("3", "r", "a/b"), ("4", None, "a"), ("5", "s", None)], "id string, repo string, path string")
    assert set(rows_of(links.contained(p, ch, "repo", "path", "id"), "parent", "child")) == {("P", "1"), ("P", "3"), ("root", "1"), ("root", "2"), ("root", "3")}
    pairs = spark.createDataFrame([("1", "x"), ("1", "y"), ("1", "x"), ("2", "x"), ("2", "y"), ("2", "z")], "id string, service string")
    assert ("x", "y", 2, 1) in rows_of(links.co_occurrences(pairs), "service", "other", "together", "place")
    snap = spark.createDataFrame([("2026-01-01", "a", 1), ("2026-01-08", "a", 5), ("2026-01-10", "a", 9), ("2026-01-10", "b", 3), ("2026-01-10", None, 3)], "d string, k string, v int").withColumn("d", F.to_date("d"))
    assert rows_of(links.growth(snap, "d", "k", "v"), "k", "now", "before", "delta") == [("a", 9, 1, 8)]
    assert rows_of(links.growth(snap.where("d >= '2026-01-08'"), "d", "k", "v"), "k", "delta") == [("a", 4)]
    assert links.growth(snap.where("d = '2026-01-10'"), "d", "k", "v").count() == 0


def test_neighbours_duplicates_recall_and_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base, base[:10] + 0.01 * rng.normal(size=(10, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in r], 7) for i, r in enumerate(v)], "id long, v array<float>, similarity int")
    exact = vectors.exact_neighbours(df, "id", "v", 3, blocks=3).cache()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert {(r["id"], r["neighbour"]) for r in exact.collect()} == {(i, int(j)) for i in range(50) for j in np.argsort(-s[i], kind="stable")[:3]}
    r = vectors.recall(exact, vectors.hashed_neighbours(df, "id", "v", 3), 0.9).first()
    assert r["wrong"] == 0 and r["pair_recall"] == 1.0
    d = {r["id"]: r for r in vectors.near_duplicates(df, "id", "v", [F.col("id")], 0.92).collect()}
    assert all(d[40 + i]["canonical"] == i and d[40 + i]["is_duplicate"] and not d[i]["is_duplicate"] for i in range(10)) and d[20]["novelty"] > 0.08
    assert vectors.clusters(df, "id", "v", 4).select("cluster").distinct().count() <= 4
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(80)], "id long, v array<float>")
    assert vectors.near_duplicates(same, "id", "v", [F.col("id")]).where("is_duplicate").count() == 79


def test_vector_reasons(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [2.0, 1.0])], "id int, v array<float>")
    size = vectors.modal_size(df, "v").first()["size"]
    got = dict(rows_of(df.select("id", vectors.invalid_reason(F.col("v"), F.lit(size)).alias("r")), "id", "r"))
    assert got == {0: None, 1: "missing", 2: "size", 3: "not_finite", 4: "zero", 5: "not_finite", 6: None}


def test_reports_limits_and_hot_joins(spark):
    df = spark.createDataFrame([(0.05,), (0.999,), (1.7,), (-3.0,), (None,)], "v double")
    assert sorted(rows_of(reports.histogram(df, F.col("v"), 4), "bin", "n")) == [(0, 2), (1, 0), (2, 0), (3, 2)]
    found = reports.expectations(spark.range(3).agg(F.count(F.lit(1)).alias("n")), {"some": (F.col("n") == 0).cast("int"), "few": F.col("n")})
    with pytest.raises(ValueError, match="few: 3"):
        reports.enforce(found)
    log = spark.createDataFrame([(i, "k", f"2026-01-01 00:00:{i:02}") for i in range(0, 60, 10)], "i int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert rows_of(sessions.over_limit(log, ["k"], "t", 60, 4, [F.col("t")]), "i") == [(40,), (50,)]
    assert sorted(r["n"] for r in sessions.gap_sessions(log.where("i <> 30"), "k", "t", "15 seconds").collect()) == [2, 3]
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "key string, v int")
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert [r[0] for r in hot_keys(n.where("key is not null"), "key", share=0.1).collect()] == ["hot"]
    per = rows.where("key is not null").select("key", F.length("key").alias("w")).distinct()
    assert join_by_key(rows, per, n, "key").count() == 3000 and join_by_key(rows, per.where("key <> 'hot'"), n, "key", "left").count() == 3001


def test_rank_in_groups_equals_a_window(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 2000).alias("x"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, None).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    got = {(r["g"], r["x"]): r["rank"] for r in ranking.rank_in_groups(df, "g", [F.desc("x")]).collect()}
    want = {(r["g"], r["x"]): r["rank"] for r in df.where("g is not null").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x")))).collect()}
    assert got == want and ranking.rank_in_groups(df.where("false"), "g", [F.col("x")]).count() == 0


def test_written_tables_can_be_cleared(spark):
    from sparkloom.runtime import clear, written

    clear(spark)
    written(spark.range(3), "t")
    assert clear(spark) == 1 and clear(spark) == 0
