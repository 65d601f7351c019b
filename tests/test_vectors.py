import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators import vectors
from sparkloom.plans import nearest

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@tables
def test_hashed_top3_finds_the_true_top3(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    exact = vectors.exact_neighbours(e, "vec_id", "embedding", 3)
    r = vectors.recall(exact, entry.queries()["hashed_top3"](spark, SMALL), 0.4).first()
    assert r["wrong"] == 0 and r["overlap"] >= 0.9 and r["pair_recall"] >= 0.9


@tables
def test_hashed_recall_measures_what_hashed_top3_returns(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HASHED", {"tables": 12, "bits": 6})
    assert not entry.queries()["hashed_recall"](spark, SMALL).first()["most_found"]


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")


def two_groups(rng, n):
    """Two groups of ``n`` near copies; every cosine across is above 0.94 and below those within."""
    a, b = np.eye(16)[0], np.eye(16)[0] * 0.95 + np.eye(16)[1] * np.sqrt(1 - 0.95**2)
    return np.concatenate([a + 1e-4 * rng.normal(size=(n, 16)), b + 1e-4 * rng.normal(size=(n, 16))])


def test_duplicates_join_beyond_the_nearest(spark):
    d = vectors.near_duplicates(frame(spark, two_groups(np.random.default_rng(1), 100)), "id", "v", [F.col("id")], 0.92).collect()
    assert {r["component"] for r in d} == {0} and sum(r["is_duplicate"] for r in d) == 199


@pytest.mark.parametrize("blocks", [1, 3])
def test_links_give_the_components_and_nearest_of_all_pairs(spark, blocks):
    rng = np.random.default_rng(2)
    v = np.concatenate([two_groups(rng, 70), rng.normal(size=(600, 16)), np.ones((80, 16))])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    part = np.arange(len(v))
    while True:
        low = np.minimum(part, np.where(s > 0.7, part[None, :], len(v)).min(axis=1))
        if (low == part).all():
            break
        part = low
    near = vectors.linked(frame(spark, v), "id", "v", 0.7, blocks=blocks).cache()
    got = {r["id"]: r["top"] for r in near.groupBy("id").agg(F.max("similarity").alias("top")).collect()}
    assert np.allclose([got[i] for i in range(len(v))], s.max(axis=1))
    e = near.where("similarity > 0.7").select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    found = {r["node"]: r["component"] for r in vectors.connected_components(e).collect()}
    assert [found.get(i, i) for i in range(len(v))] == part.tolist()
    assert near.count() <= 3 * len(v) * blocks


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(n // 20, 24))
    return heads[rng.integers(0, len(heads), n)] + 0.25 * rng.normal(size=(n, 24))


def test_cells_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 50)
    v = clustered(1500)
    df = frame(spark, v)
    cells = vectors.Cells(df, "id", "v", cell=50, part=40)
    assert len(cells.centres) == 30 and max(cells.parts.values()) > 1
    probes = cells.probes_for(3, 0.98)
    assert 1 <= probes < 30
    exact = vectors.exact_neighbours(df, "id", "v", 3)
    g = vectors.gates(exact, cells.nearest(3, probes), 0.9).first()
    assert g["wrong"] == 0 and g["overlap"] >= 0.95 and g["pair_recall"] >= 0.95 and g["flap"] < 0.02
    same = vectors.gates(exact, cells.nearest(3, 30), 0.9).first()
    assert (same["pair_recall"], same["flap"], same["overlap"], same["novelty_jaccard"]) == (1, 0, 1, 1)


def test_cell_links_lose_no_pair_and_leave_far_cells_alone(spark):
    v = clustered(1500)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    part = np.arange(len(v))
    while True:
        low = np.minimum(part, np.where(s > 0.95, part[None, :], len(v)).min(axis=1))
        if (low == part).all():
            break
        part = low
    cells = vectors.Cells(frame(spark, v), "id", "v", cell=50, part=40)
    assert len(cells.meetings(float(np.arccos(0.95)))) < 30 * 31 // 2
    e = vectors.cell_links(cells, 0.95).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    found = {r["node"]: r["component"] for r in vectors.connected_components(e).collect()}
    assert [found.get(i, i) for i in range(len(v))] == part.tolist()


def test_cells_of_empty_and_tiny_tables(spark):
    df = frame(spark, np.eye(3))
    assert vectors.indexed_neighbours(df.where("false"), "id", "v", 2).count() == 0
    assert vectors.near_duplicates(df.where("false"), "id", "v", [F.col("id")]).count() == 0
    assert {(r["id"], r["component"], r["novelty"]) for r in vectors.near_duplicates(df, "id", "v", [F.col("id")]).collect()} == {(i, i, 1.0) for i in range(3)}
    assert vectors.indexed_neighbours(df, "id", "v", 5).count() == 6
