import random
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.capping import cap_per_contributor, repository
from sparkloom.llm.cutoffs import DyadicTree, ScoreCode, share_cutoffs
from sparkloom.runtime import shared_dir

ROWS = "id string, kind string, score double, source string, leaf long, n long"


def tree_of(spark, code, *batches):
    tree = DyadicTree(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", code)
    for rows, sign in batches:
        tree.add(rows, "kind", "score", sign=sign)
    return tree


@pytest.mark.parametrize("code", [ScoreCode(), ScoreCode(low=-5, width=7.5, bits=3), ScoreCode(low=40, width=0.01, bits=10)])
def test_cutoffs_equal_sorting_for_any_code(spark, code):
    rng = random.Random(3)
    rows = [(str(i), rng.choice("aab") if i % 9 else "hot", rng.choice([rng.randrange(101), rng.random() * 100, 50.0]) * 1.0, "x", 1, 2) for i in range(600)]
    dirt = [("n1", None, 3.0, "", 0, 0), ("n2", "a", None, "", 0, 0), ("n3", "a", float("nan"), "", 0, 0), ("n4", "empty", None, "", 0, 0)]
    df = spark.createDataFrame(rows + dirt, ROWS)
    targets = spark.createDataFrame([("a", 30), ("b", 100), ("hot", 0), ("absent", 10), ("empty", 10), (None, 5), ("a", 30)], "kind string, pct int")
    got = {r["source"]: r for r in share_cutoffs(tree_of(spark, code, (df, 1)), df, targets, "kind", "score", "pct").collect()}
    assert set(got) == {"a", "b", "hot"}
    for kind, pct in (("a", 30), ("b", 100), ("hot", 0)):
        s = sorted((r[2] for r in rows if r[1] == kind), reverse=True)
        cut = next(c for c in sorted(set(s), reverse=True) if 100 * sum(x >= c for x in s) >= pct * len(s))
        assert got[kind]["cutoff"] == cut and got[kind]["kept"] == sum(x >= cut for x in s) and got[kind]["total"] == len(s)


def test_batches_add_and_are_taken_back(spark):
    rows = [(str(i), "a", float(i % 10), "", 0, 0) for i in range(100)]
    df = spark.createDataFrame(rows, ROWS)
    old, late = df.where("cast(id as int) < 60"), df.where("cast(id as int) >= 60")
    gone = df.where("cast(id as int) < 10")
    tree = tree_of(spark, ScoreCode(), (old, 1), (late, 1), (gone, -1))
    left = df.where("cast(id as int) >= 10")
    targets = spark.createDataFrame([("a", 25)], "kind string, pct int")
    got = share_cutoffs(tree, left, targets, "kind", "score", "pct").first()
    assert (got["total"], got["cutoff"], got["kept"]) == (90, 7.0, 27)


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    targets = spark.createDataFrame([], "kind string, pct int")
    assert share_cutoffs(tree_of(spark, ScoreCode(), (df, 1)), df, targets, "kind", "score", "pct").count() == 0


def test_cap_equals_sorting_with_a_hot_contributor_and_ties(spark):
    rng = random.Random(4)
    rows = [(f"i{i:05}", "Hot/Repo.git " if i % 3 == 0 else f"r{rng.randrange(150)}", rng.choice([None, float("nan"), 1.5, 2.0, 90.0, rng.random()]), "s", 1, 2) for i in range(3000)]
    rows += [(f"t{i:03}", "hot/repo", None, "s", 1, 2) for i in range(50)] + [(None, "hot/repo", 1.0, "s", 1, 2), ("nobody", None, 99.0, "s", 1, 2), (rows[0][0], rows[0][1], -3.0, "s", 1, 2)]
    df = spark.createDataFrame(rows, ROWS)
    capped = cap_per_contributor(df, repository(F.col("kind")), F.col("score"), cap=10)
    best = {}
    for i, k, s, *_ in rows:
        if i is not None and k is not None:
            s = None if s is None or s != s else s
            c = k.strip().lower().removesuffix(".git")
            old = best.get(i)
            best[i] = (c, max((x for x in (s, old[1] if old else None) if x is not None), default=None))
    by = {}
    for i, (c, s) in best.items():
        by.setdefault(c, []).append((s is None, -(s or 0), i))
    kept = {x[2] for v in by.values() for x in sorted(v)[:10]}
    assert {r[0] for r in capped.kept.select("id").collect()} == kept
    assert {r[0] for r in capped.left_out.select("id").collect()} == set(best) - kept


def test_cap_by_share_none_and_empty(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 60 else str(i), 1.0 * i, "", 0, 0) for i in range(100)], ROWS)
    assert cap_per_contributor(df, F.col("kind"), F.col("score"), share=0.2).kept.where("contributor = 'a'").count() == 20
    assert cap_per_contributor(df, F.col("kind"), F.col("score"), cap=0).kept.count() == 0
    empty = cap_per_contributor(df.where("false"), F.col("kind"), F.col("score"), cap=3)
    assert empty.kept.count() == empty.left_out.count() == 0
    with pytest.raises(ValueError):
        cap_per_contributor(df, F.col("kind"), F.col("score"))


def test_stored_catalog_takes_back_replaced_states(spark):
    from sparkloom.llm.cutoffs import StoredCatalog
    from sparkloom.runtime import scratch

    schema = "id string, source string, score long, order long"
    path = scratch(spark, "catalog")
    StoredCatalog(spark, path).add(spark.createDataFrame([("a", "s", 10, 1), ("b", "s", 20, 1), ("c", "t", 5, 3), ("d", "s", None, 1), (None, "s", 1, 1), ("a", "s", 99, 0)], schema))
    stored = StoredCatalog(spark, path)
    assert stored.batches == 1
    stored.add(spark.createDataFrame([("a", "t", 30, 2), ("c", "t", 77, 2), ("d", "s", 7, 2), ("b", "s", None, 9)], schema))
    assert {(r["id"], r["source"], r["score"]) for r in stored.current().collect()} == {("a", "t", 30), ("b", "s", None), ("c", "t", 5), ("d", "s", 7)}
    targets = spark.createDataFrame([("s", 100), ("t", 50)], "source string, target_pct long")
    got = {r["source"]: (r["total"], r["cutoff"], r["kept"]) for r in share_cutoffs(stored.tree, stored.current(), targets, "source", "score", "target_pct").collect()}
    assert got == {"s": (1, 7, 1), "t": (2, 30, 1)}


def test_caps_above_the_group_limit_give_the_same_rows(spark, monkeypatch):
    from sparkloom.llm import capping

    df = spark.createDataFrame([(f"i{i:04}", "hot" if i % 3 else "cold", float(i % 4), "", 0, 0) for i in range(900)], ROWS)
    want = {r[0] for r in cap_per_contributor(df, F.col("kind"), F.col("score"), cap=100).kept.select("id").collect()}
    monkeypatch.setattr(capping, "GROUP_LIMIT", 20)
    assert {r[0] for r in cap_per_contributor(df, F.col("kind"), F.col("score"), cap=100).kept.select("id").collect()} == want and len(want) == 200
