import os

import numpy as np
import pytest

import __spark_entry__ as entry
from sparkloom.operators.meetings import Meetings

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def vectors():
    """Groups of near vectors, a third of all rows one vector, some vectors twice in another length."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(60, 24)) + 0.8
    v = np.concatenate([heads[rng.integers(0, 60, 900)] + 0.3 * rng.normal(size=(900, 24)), np.ones((500, 24)), np.repeat(heads, 2, axis=0)])
    v[-120::2] *= 2
    return v.astype(np.float32)


def cosines(v):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")


def test_nearest_of_all_pairs_with_copies_and_ties(spark, vectors):
    m = Meetings(frame(spark, vectors), "id", "v", block=200, least=3)
    assert m.blocks > 5
    got = {(r["id"], r["place"]): r["neighbour"] for r in m.listed(m.nearest(3, digits=12), 3).collect()}
    s = np.round(cosines(vectors), 12)
    want = {(i, p + 1): int(j) for i in range(len(s)) for p, j in enumerate(np.lexsort((np.arange(len(s)), -s[i]))[:3])}
    assert got == want


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_groups_of_all_pairs_above_the_threshold(spark, vectors, threshold):
    s = cosines(vectors)
    part = np.arange(len(s))
    while True:
        low = np.minimum(part, np.where(s > threshold, part[None, :], len(s)).min(axis=1))
        if (low == part).all():
            break
        part = low
    got = {r["id"]: r["component"] for r in Meetings(frame(spark, vectors), "id", "v", block=200, least=3).grouped(threshold).collect()}
    assert [got[i] for i in range(len(s))] == part.tolist()


def test_empty_and_single(spark):
    for rows in ([], [[1.0, 2.0]]):
        m = Meetings(frame(spark, rows), "id", "v")
        assert m.listed(m.nearest(3), 3).count() == 0 and m.grouped(0.9).count() == len(rows)


def shuffles_per_pair(df):
    """Whether blocks reach the blocks that they meet through a shuffle, in one copy for each."""
    return "CoGroup" in df._jdf.queryExecution().executedPlan().toString()


@tables
def test_similar_items_ships_no_block_twice(spark):
    assert not shuffles_per_pair(entry.queries()["similar_items"](spark, SMALL))


@tables
def test_duplicate_records_ships_no_block_twice(spark):
    from sparkloom.operators import meetings
    from sparkloom.plans import nearest

    seen = []
    real = meetings.Meetings.met
    try:
        meetings.Meetings.met = lambda *a: seen.append(real(*a)) or seen[-1]
        nearest.duplicate_records(spark, SMALL)
    finally:
        meetings.Meetings.met = real
    assert len(seen) == 1 and not shuffles_per_pair(seen[0])
