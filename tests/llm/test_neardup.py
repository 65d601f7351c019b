import random

import numpy as np

from sparkloom.llm.neardup import fast_similarity_sketch, similar_groups, similar_pairs, similar_texts
from pyspark.sql import functions as F

SCHEMA = "id string, body string, slug string, k long, norm string, x int"


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n)]


def grams(t, n):
    w = t.lower().split()
    return set(zip(*(w[i:] for i in range(n))))


def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = words(rng, 80)
        for c in range(5):
            w = list(base)
            for _ in range(c * 2):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            rows.append((f"g{g}-{c}", " ".join(w)))
    rows += [(f"copy{i}", rows[0][1].upper().replace(" ", ",  ")) for i in range(30)]
    return rows


def test_pairs_equal_brute_force_with_copies_and_dirt(spark):
    rows = corpus()
    dirt = [("null", None), ("empty", ""), ("short", "one two three"), (None, rows[0][1]), ("long", " ".join(words(random.Random(9), 60_000)))]
    df = spark.createDataFrame([(i, t, "s", 1, "n", 2) for i, t in rows + dirt] + [(rows[3][0], rows[3][1], "s", 1, "n", 2)], SCHEMA)
    got = {tuple(r) for r in similar_pairs(similar_texts(df, "id", "body", shingle=3, threshold=0.6, min_words=20)).collect()}
    plain = {i: t.lower().replace(",", " ") for i, t in rows}
    sets = {i: grams(" ".join(t.split()), 3) for i, t in plain.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = similar_texts(df, "id", "body")
    assert similar_pairs(found).count() == 0 and found.members.count() == 0


def test_groups_have_one_canonical_and_a_row_for_each_record(spark):
    rows = corpus() + [("alone", "nothing like it")]
    df = spark.createDataFrame([(i, t, "slug-" + i, 1, "n", 2) for i, t in rows], SCHEMA)
    out = similar_groups(df, "id", "body", [F.lit(None).cast("string")], F.col("slug"), shingle=3, threshold=0.6, min_words=3).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)
    by = {r["id"]: r for r in out}
    assert by["copy3"]["group_id"] == by["g0-0"]["group_id"] and by["copy3"]["canonical"] == by["g0-0"]["canonical"] == "slug-copy0"
    assert by["alone"]["group_size"] == 1 and by["alone"]["links"] == 0 and by["alone"]["canonical"] == "slug-alone"


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    b = np.concatenate([a[:75], rng.integers(0, 2**63, 25).astype(np.uint64)])
    one = a[:1]
    e, d = np.concatenate([a, b, one]), np.repeat([0, 1, 2], [100, 100, 1])
    s = fast_similarity_sketch(e, d, 4, 400)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 75 / 125) < 0.1


def test_no_join_of_texts_is_a_broadcast(spark):
    """Small tables whose estimates are far below the threshold: hints alone must keep texts off the driver."""
    df = spark.createDataFrame([(i, t, "slug", 1, "n", 2) for i, t in corpus()], SCHEMA)
    found = similar_texts(df, "id", "body", shingle=3, threshold=0.6, min_words=20)
    for out in (found.links, similar_pairs(found)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
