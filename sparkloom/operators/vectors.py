"""Vectors: validation, exact and approximate neighbours, near-duplicate components, clusters, recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, merged, written
from .components import connected_components

#: Rows of a block in exact search; block meets block, one task each.
BLOCK_ROWS = 20_000


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """``v`` scaled to length 1, in double precision; the zero vector stays as it is."""
    n = length(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has length 0."""
    return dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0))


def modal_size(df: DataFrame, v: str) -> DataFrame:
    """One row (size, n): the most frequent number of components, the larger on ties."""
    return df.where(F.col(v).isNotNull()).groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1)


def invalid_reason(v: Column, size: Column) -> Column:
    """Why a vector cannot be used: missing, size, not_finite, zero; null where it can."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != size, "size").when(bad, "not_finite").when(length(v) == 0, "zero")


def _blocked(df: DataFrame, id_col: str, v: str, blocks: int) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(v).isNotNull()).select(F.col(id_col).alias("id"), F.col(v).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))


def exact_neighbours(df: DataFrame, id_col: str, v: str, k: int, queries: DataFrame | None = None, min_similarity: float = -2.0, blocks: int | None = None, query_blocks: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, place): the ``k`` nearest by cosine of every row, or of ``queries``, against all rows, ties by smaller id.

    ``query_blocks`` is for few queries: each row is shipped once for each of their blocks. Blocks of queries meet blocks of rows, one task and one matrix product each; nothing is collected. Vectors must be valid
    (see ``invalid_reason``); a row is not its own neighbour.
    """
    queries = df if queries is None else queries
    blocks = blocks or max(1, -(-df.count() // BLOCK_ROWS))
    kind = df.schema[id_col].dataType.simpleString()
    query_blocks = query_blocks or blocks
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    q = _blocked(queries, id_col, v, query_blocks).select("id", "v", F.col("block").alias("by"), F.explode(every(blocks)).alias("to"))
    x = _blocked(df, id_col, v, blocks).select(F.col("id").alias("xid"), F.col("v").alias("xv"), F.col("block").alias("xto"), F.explode(every(query_blocks)).alias("xby"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        if not len(a) or not len(b):
            return empty
        norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        b = b.sort_values("xid", kind="stable")
        m, ids, own = norm(np.stack(b["xv"].to_numpy())), b["xid"].to_numpy(), a["id"].to_numpy()
        qs, out = norm(np.stack(a["v"].to_numpy())), []
        for at in range(0, len(a), 512):
            s = qs[at : at + 512] @ m.T
            s[own[at : at + 512, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            # All that reach the n-th greatest, so that ties are decided by id.
            floor = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            r, c = np.nonzero((s >= np.maximum(floor - 1e-12, min_similarity)) & np.isfinite(s))
            out.append(pd.DataFrame({"id": own[at + r], "neighbour": ids[c], "similarity": s[r, c]}))
        return pd.concat(out)

    near = q.groupBy("by", "to").cogroup(x.groupBy("xby", "xto")).applyInPandas(meet, f"id {kind}, neighbour {kind}, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hashed_neighbours(df: DataFrame, id_col: str, v: str, k: int, tables: int = 12, bits: int = 6, seed: int = 11) -> DataFrame:
    """Approximate neighbours: candidates share the signs of ``bits`` random hyperplanes in one of ``tables`` tables, all are verified exactly.

    Columns as in :func:`exact_neighbours`; a true neighbour can only be missed, never wrong. Equal vectors are collapsed before tables
    are joined.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(v).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(v)).alias("u"))
    size = rows.select(F.size("u")).first()
    if size is None:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("place"))
    planes = np.random.default_rng(seed).standard_normal((size[0], tables * bits)).astype(np.float32)

    @F.pandas_udf("array<int>")
    def keys(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for u in it:
            signs = (np.stack(u.to_numpy()) @ planes > 0).reshape(len(u), tables, bits)
            yield pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)))

    coded = written(rows.withColumn("keys", keys("u")), "hashed")
    buckets = coded.select("id", F.posexplode("keys").alias("table", "key"))
    l, r = buckets.alias("l"), buckets.alias("r")
    pairs = l.join(r, (F.col("l.table") == F.col("r.table")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    a, b = coded.select(F.col("id").alias("a"), F.col("u").alias("ua")), coded.select(F.col("id").alias("b"), F.col("u").alias("ub"))
    sims = pairs.join(a, "a").join(b, "b").select("a", "b", dot(F.col("ua"), F.col("ub")).alias("similarity"))
    both = sims.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "similarity").union(sims.select("b", "a", "similarity"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def linked(df: DataFrame, id_col: str, v: str, threshold: float, blocks: int | None = None) -> DataFrame:
    """(id, neighbour, similarity): the nearest of every row in each block, and links above ``threshold`` that join what all pairs above it join.

    Every pair is looked at. Of the pairs above the threshold in one block product a spanning forest is kept, so a group of any size
    costs at most one row a vector and product, and components over the result are those over all pairs. Vectors as in
    :func:`exact_neighbours`.
    """
    blocks = blocks or max(1, -(-df.count() // BLOCK_ROWS))
    kind = df.schema[id_col].dataType.simpleString()
    x = _blocked(df, id_col, v, blocks)
    q = x.select("id", "v", F.col("block").alias("by"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("to"))
    y = x.select("id", "v", F.col("block").alias("to"), F.explode(F.sequence(F.lit(0), "block")).alias("by"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        qs, m = norm(np.stack(a["v"].to_numpy())), norm(np.stack(b["v"].to_numpy()))
        own, ids, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        nodes, at = np.unique(np.concatenate([own, ids]), return_inverse=True)
        left, right, part = at[: len(own)], at[len(own) :], np.arange(len(nodes))
        best, of = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)

        def keep(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
            out.append(pd.DataFrame({"id": own[r], "neighbour": ids[c], "similarity": s}))

        for first in range(0, len(own), 512):
            s = qs[first : first + 512] @ m.T
            s[own[first : first + 512, None] == ids[None, :]] = -np.inf
            rows = np.arange(len(s))
            c = s.argmax(axis=1)
            ok = np.isfinite(s[rows, c])
            keep(first + rows[ok], c[ok], s[rows[ok], c[ok]])
            r, top = s.argmax(axis=0), s.max(axis=0)
            of, best = np.where(top > best, first + r, of), np.maximum(top, best)
            for i in np.flatnonzero((s > threshold).any(axis=1)):
                cols = np.flatnonzero(s[i] > threshold)
                cols = cols[part[right[cols]] != part[left[first + i]]]
                if len(cols):
                    parts, one = np.unique(part[right[cols]], return_index=True)
                    keep(np.full(len(one), first + i), cols[one], s[i, cols[one]])
                    to = np.arange(len(nodes))
                    to[parts] = part[left[first + i]]
                    part = to[part]
        c = np.flatnonzero(np.isfinite(best))
        out.append(pd.DataFrame({"id": ids[c], "neighbour": own[of[c]], "similarity": best[c]}))
        return pd.concat(out)

    return q.groupBy("by", "to").cogroup(y.groupBy("by", "to")).applyInPandas(meet, f"id {kind}, neighbour {kind}, similarity double")


#: Vectors of a cell, about; vectors that the cells are fitted on, at most; cells, at most; queries by which the number of probed cells is set.
CELL, FIT, MAX_CELLS, TRIALS = 500, 20_000, 4096, 200


def spherical_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of ``cells`` groups of the unit rows of ``x`` by Lloyd rounds on the sphere."""
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1e-300), c)
    return c


class Cells:
    """An index over the valid vectors of a table: each vector belongs to the nearest of some centres. The centres are fitted on a bounded
    sample, their number grows with the table; every vector is indexed. A cell with more than ``part`` vectors is cut by hash.

    rows: id, u (unit vector), cell, part. Vectors must be valid (see ``invalid_reason``), ids unique.
    """

    def __init__(self, df: DataFrame, id_col: str, v: str, cell: int = CELL, part: int = BLOCK_ROWS):
        self.id_kind = df.schema[id_col].dataType.simpleString()
        rows = written(df.where(F.col(id_col).isNotNull() & F.col(v).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(v)).alias("u")), "units")
        self.n = rows.count()
        sample = [r["u"] for r in rows.orderBy(F.xxhash64("id")).limit(FIT).select("u").collect()]  # FIT rows at most
        self.centres = centres = spherical_centres(np.array(sample), max(1, min(MAX_CELLS, self.n // cell))) if sample else np.zeros((1, 1))

        @F.pandas_udf("struct<cell:int,angle:double>")
        def nearest(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for u in it:
                s = np.stack(u.to_numpy()) @ centres.T
                yield pd.DataFrame({"cell": s.argmax(axis=1).astype(np.int32), "angle": np.arccos(np.clip(s.max(axis=1), -1, 1))})

        placed = written(rows.withColumn("_c", nearest("u")).select("id", "u", "_c.cell", "_c.angle"), "cells")
        # One row per cell.
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas()
        self.parts = dict(zip(sizes["cell"], np.ceil(sizes["n"] / part).astype(int)))
        self.radius = np.full(len(self.centres), -np.inf)
        self.radius[sizes["cell"].to_numpy(int)] = sizes["radius"]
        parts = F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in self.parts.items() for x in kv]), F.col("cell")) if self.parts else F.lit(1)
        self.rows = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def nearest(self, k: int, probes: int) -> DataFrame:
        """(id, neighbour, similarity, place): the ``k`` nearest of every vector among those of the ``probes`` nearest cells, ties by smaller id."""
        centres, parts, kind = self.centres, self.parts, self.id_kind
        probes = min(probes, len(centres))

        @F.pandas_udf("array<struct<cell:int,part:int>>")
        def asked(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for u in it:
                near = np.argsort(-(np.stack(u.to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pd.Series([[{"cell": int(c), "part": p} for c in row for p in range(parts.get(int(c), 0))] for row in near])

        q = self.rows.select("id", "u", F.explode(asked("u")).alias("to")).select("id", "u", "to.cell", "to.part")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
            b = b.sort_values("xid", kind="stable")
            return top_similar(np.stack(a["u"].to_numpy()), a["id"].to_numpy(), np.stack(b["xu"].to_numpy()), b["xid"].to_numpy(), k)

        x = self.rows.select(F.col("id").alias("xid"), F.col("u").alias("xu"), F.col("cell").alias("xcell"), F.col("part").alias("xpart"))
        near = q.groupBy("cell", "part").cogroup(x.groupBy("xcell", "xpart")).applyInPandas(meet, f"id {kind}, neighbour {kind}, similarity double")
        order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
        return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def probes_for(self, k: int, recall: float) -> int:
        """The number of cells in which ``recall`` of the true ``k`` nearest of TRIALS vectors lie, by brute force over all vectors."""
        if len(self.centres) == 1 or not self.n:
            return 1
        trial = self.rows.orderBy(F.xxhash64(F.lit("trial"), "id")).limit(TRIALS).select("id", "u")
        true = exact_neighbours(self.rows.select("id", "u"), "id", "u", k, trial, query_blocks=1).select("id", "neighbour")
        found = true.join(self.rows.select(F.col("id").alias("neighbour"), "cell"), "neighbour").join(F.broadcast(trial), "id").select("u", "cell").toPandas()  # k * TRIALS rows at most
        rank = np.argsort(np.argsort(-(np.stack(found["u"].to_numpy()) @ self.centres.T), axis=1, kind="stable"), axis=1)[np.arange(len(found)), found["cell"].to_numpy(int)]
        return int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1

    def meetings(self, angle: float) -> list[tuple[int, int]]:
        """Pairs of cells, a <= b, that can hold two vectors no farther apart than ``angle``: by the triangle inequality no other pair can."""
        between = np.arccos(np.clip(self.centres @ self.centres.T, -1, 1))
        a, b = np.nonzero(np.triu(between <= angle + self.radius[:, None] + self.radius[None, :] + 1e-9))
        return list(zip(a.tolist(), b.tolist()))


def top_similar(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> pd.DataFrame:
    """(id, neighbour, similarity): all rows of ``x`` that reach the k-th greatest product with each row of ``q``, rows of the same id left out."""
    out = []
    for at in range(0, len(q), 512):
        s = q[at : at + 512] @ x.T
        s[q_id[at : at + 512, None] == x_id[None, :]] = -np.inf
        n = min(k, len(x_id))
        floor = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        r, c = np.nonzero((s >= floor - 1e-12) & np.isfinite(s))
        out.append(pd.DataFrame({"id": q_id[at + r], "neighbour": x_id[c], "similarity": s[r, c]}))
    return pd.concat(out)


def indexed_neighbours(df: DataFrame, id_col: str, v: str, k: int, recall: float = 0.98) -> DataFrame:
    """Approximate neighbours by :class:`Cells`: as many cells are probed as hold ``recall`` of the true neighbours of a sample of queries.

    Columns as in :func:`exact_neighbours`; similarities are exact, a true neighbour can only be missed. The work is that of the
    probed cells: in proportion to the table where neighbours are near, towards all pairs where they are as far as any other vector.
    """
    cells = Cells(df, id_col, v)
    return cells.nearest(k, cells.probes_for(k, recall))


def cell_links(cells: Cells, threshold: float) -> DataFrame:
    """(id, neighbour, similarity): links above ``threshold`` that join what all pairs above it join.

    Only cells that can hold such a pair meet, one task each, so nothing is missed. Of the pairs in one meeting a spanning forest is
    kept: a group of any size costs at most one row a vector and meeting, and components over the result are those over all pairs.
    """
    kind, parts = cells.id_kind, cells.parts
    spark = cells.rows.sparkSession
    met = [(n, a, i, b, j) for n, (a, b, i, j) in enumerate((a, b, i, j) for a, b in cells.meetings(float(np.arccos(np.clip(threshold, -1, 1)))) for i in range(parts.get(a, 0)) for j in range(parts.get(b, 0)) if a != b or i <= j)]
    schema = "meeting long, cell int, part int"
    left, right = ([(m[0], m[at], m[at + 1]) for m in met] for at in (1, 3))
    own = cells.rows.select("id", "u", "cell", "part")
    q = merged(own, spark.createDataFrame(left, schema), ["cell", "part"])
    y = merged(own, spark.createDataFrame(right, schema), ["cell", "part"]).select(F.col("meeting").alias("at"), F.col("id").alias("xid"), F.col("u").alias("xu"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        qs, m = np.stack(a["u"].to_numpy()), np.stack(b["xu"].to_numpy())
        own, ids, out = a["id"].to_numpy(), b["xid"].to_numpy(), [pd.DataFrame({"id": a["id"][:0], "neighbour": a["id"][:0], "similarity": np.empty(0)})]
        nodes, at = np.unique(np.concatenate([own, ids]), return_inverse=True)
        left, right, part = at[: len(own)], at[len(own) :], np.arange(len(nodes))
        for first in range(0, len(own), 512):
            s = qs[first : first + 512] @ m.T
            s[own[first : first + 512, None] == ids[None, :]] = -np.inf
            for i in np.flatnonzero((s > threshold).any(axis=1)):
                cols = np.flatnonzero(s[i] > threshold)
                cols = cols[part[right[cols]] != part[left[first + i]]]
                if len(cols):
                    groups, one = np.unique(part[right[cols]], return_index=True)
                    out.append(pd.DataFrame({"id": np.repeat(own[first + i], len(one)), "neighbour": ids[cols[one]], "similarity": s[i, cols[one]]}))
                    to = np.arange(len(nodes))
                    to[groups] = part[left[first + i]]
                    part = to[part]
        return pd.concat(out)

    return q.groupBy("meeting").cogroup(y.groupBy("at")).applyInPandas(meet, f"id {kind}, neighbour {kind}, similarity double")


def near_duplicates(df: DataFrame, id_col: str, v: str, order: list[Column], threshold: float = 0.92, recall: float = 0.98) -> DataFrame:
    """(id, component, canonical, is_duplicate, novelty): components over all pairs above ``threshold``.

    canonical is the first of a component in ``order`` (then id); novelty is 1 - similarity of the nearest, within 0..1. Components are
    exact; the nearest is that of the cells which hold ``recall`` of the nearest (see :func:`indexed_neighbours`). 1 keeps all cells.
    """
    cells = Cells(df, id_col, v)
    parts = connected_components(written(cell_links(cells, threshold), "links").select(F.col("id").alias("a"), F.col("neighbour").alias("b")))
    best = cells.nearest(1, cells.probes_for(1, recall) if recall < 1 else len(cells.centres)).groupBy("id").agg(F.max("similarity").alias("top"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(v).isNotNull()).select(F.col(id_col).alias("id"), F.struct(*order, F.col(id_col)).alias("_order"))
    rows = merged(merged(rows, best, "id", "left"), parts.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    heads = rows.groupBy("component").agg(F.min_by("id", "_order").alias("canonical"))
    novelty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("top", F.lit(0.0))))
    return merged(rows, heads, "component").select("id", "component", "canonical", (F.col("id") != F.col("canonical")).alias("is_duplicate"), novelty.alias("novelty"))


def gates(exact: DataFrame, found: DataFrame, threshold: float, share: float = 0.05) -> DataFrame:
    """One row that compares an approximate run with the exact one, both (id, neighbour, similarity): pair_recall above ``threshold``;
    flap, the share of ids that are duplicates (a neighbour above it) in one run only; overlap of the neighbours; novelty_jaccard of
    the ``share`` of ids whose nearest is farthest (ties by id)."""
    r = recall(exact, found, threshold)

    def per_id(df: DataFrame, name: str) -> DataFrame:
        top = df.groupBy("id").agg(F.max(F.round("similarity", 9)).alias("top"))
        n = top.agg(F.ceil(F.count(F.lit(1)) * share).cast("int")).first()[0] or 0
        novel = top.orderBy("top", "id").limit(n).select("id", F.lit(True).alias("novel"))
        return merged(top, novel, "id", "left").select("id", (F.col("top") > threshold).alias(f"{name}_dup"), F.coalesce("novel", F.lit(False)).alias(f"{name}_novel"))

    both = merged(per_id(exact, "a"), per_id(found, "b"), "id", "full").na.fill(False)
    flap = F.count_if(F.col("a_dup") != F.col("b_dup")) / F.nullif(F.count(F.lit(1)), F.lit(0))
    jaccard = F.count_if(F.col("a_novel") & F.col("b_novel")) / F.nullif(F.count_if(F.col("a_novel") | F.col("b_novel")), F.lit(0))
    one = both.agg(F.coalesce(flap, F.lit(0.0)).alias("flap"), F.coalesce(jaccard, F.lit(1.0)).alias("novelty_jaccard"))
    return r.select("pair_recall", one.select("flap").scalar().alias("flap"), "overlap", one.select("novelty_jaccard").scalar().alias("novelty_jaccard"), "wrong")


def recall(exact: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """One row: pair_recall above ``threshold``, overlap of the neighbour lists, wrong (pairs of ``found`` that contradict ``exact``; must be 0)."""
    e, f = exact.select("id", "neighbour", "similarity"), found.select("id", "neighbour", F.col("similarity").alias("s"))
    both = e.join(f, ["id", "neighbour"], "full")
    hit = F.col("similarity").isNotNull() & F.col("s").isNotNull()
    high = F.col("similarity") > threshold
    share = lambda part, whole: F.coalesce(F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(1.0))
    return both.agg(share(hit & high, high).alias("pair_recall"), share(hit, F.col("similarity").isNotNull()).alias("overlap"), F.count_if(hit & (F.abs(F.col("similarity") - F.col("s")) > 1e-6)).alias("wrong"))


def clusters(df: DataFrame, id_col: str, v: str, k: int = 16, seed: int = 1, rounds: int = 50) -> DataFrame:
    """(id, cluster): k-means by cosine distance, k-means|| start with a fixed seed. Vectors must be valid; fewer distinct vectors give fewer clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut(df.where(F.col(id_col).isNotNull() & F.col(v).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(v).cast("array<double>")).alias("features")))
    if rows.isEmpty():
        return rows.select("id", F.lit(0).alias("cluster"))
    model = KMeans(k=k, maxIter=rounds, tol=1e-4, seed=seed, distanceMeasure="cosine", initMode="k-means||").fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))
