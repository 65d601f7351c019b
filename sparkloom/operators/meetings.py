"""All vectors against all vectors, where neither the vectors nor copies of them are shuffled per pair of blocks.

Equal vectors are one class. Classes are cut into blocks of near vectors, one row and one partition each; a Cartesian product reads every
block once per block it meets and writes nothing. In a block the vectors lie leaf by leaf, each in the leaf of the nearest centre. A leaf with
centre c and radius r can hold x with |q - x|^2 <= D only if |q - c|^2 <= r^2 + D + 2 r sqrt(D) (the triangle inequality), and only if q lies
at most sqrt(D) beyond the plane halfway between c and any other centre; other leaves and blocks are left out, without loss. With a
``share`` below 1 these lengths are multiplied by it: the part of q - x along a given direction is a stable projection to one dimension, whose
square is D / dimensions times a chi-square variable of one degree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written
from .components import connected_components
from .ranking import global_rank

#: Vectors of a block, at most; of a leaf, about; vectors that blocks are fitted on, at most.
BLOCK, LEAF, FIT = 32_768, 128, 20_000
#: Queries of one product, and pairs that are verified at once.
STRIP, VERIFIED = 2048, 200_000


def fitted(x: np.ndarray, cells: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """``cells`` centres of the rows of ``x`` by Lloyd rounds."""
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the centres ``c`` of each row of ``x``."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[at : at + STRIP] @ c.T - half).argmax(axis=1) for at in range(0, len(x), STRIP)])


class Block:
    """The vectors of one block: n (number of the class), x (as stored), unit (single precision), leaves with centre and radius."""

    def __init__(self, n: np.ndarray, x: np.ndarray, starts: np.ndarray, centre: np.ndarray, home: np.ndarray | None = None):
        self.n, self.x, self.starts, self.centre = n, x, starts, centre
        #: The centre that is nearer to all vectors of this block than that of any other block.
        self.home = home
        self.length = np.linalg.norm(x.astype(np.float64), axis=1)
        self.unit = (x / self.length[:, None]).astype(np.float32)
        #: What a product in single precision can be wrong by.
        self.wrong = (x.shape[1] + 8) * 2.0**-23
        self.ends = np.append(starts[1:], len(n))

    @cached_property
    def radius(self) -> np.ndarray:
        off = self.unit - np.repeat(self.centre, self.ends - self.starts, axis=0)
        return np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", off, off), self.starts)) + np.float32(1e-3)

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of the leaves' centres."""
        square = (self.centre**2).sum(axis=1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * (self.centre @ self.centre.T), 0)) + np.float32(1e-3)

    @staticmethod
    def of(n: np.ndarray, x: np.ndarray) -> Block:
        """The rows in the order of their leaves."""
        unit = (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32)
        few = np.random.default_rng(7).choice(len(x), min(len(x), FIT), replace=False)
        centre = fitted(unit[few], max(1, len(x) // LEAF))
        leaf = nearest(unit, centre)
        order = np.lexsort((n, leaf))
        starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        return Block(n[order], x[order], starts, centre[leaf[order[starts]]])

    def similarity(self, r: np.ndarray, other: Block, c: np.ndarray) -> np.ndarray:
        """Cosines of pairs, in double precision, of the stored vectors."""
        dot = np.einsum("ij,ij->i", self.x[r].astype(np.float64), other.x[c].astype(np.float64))
        return dot / (self.length[r] * other.length[c])

    def reached(self, first: int, last: int, floor: np.ndarray, data: Block, share: float) -> np.ndarray:
        """(rows, leaves of ``data``): whether the leaf can hold a vector of at least cosine ``floor`` with the row."""
        q = self.unit[first:last]
        far = 1 + (data.centre**2).sum(axis=1) - 2 * (q @ data.centre.T)
        bound = np.clip(2 - 2 * floor[first:last], 0, 4).astype(np.float32)[:, None]
        r, reach = data.radius, np.float32(share) * np.sqrt(bound) + np.float32(1e-3)
        own = far.argmin(axis=1)
        can = far - far.min(axis=1, keepdims=True) <= 2 * reach * data.between[own] + np.float32(1e-5)
        if self.home is not None and data.home is not None and (apart := np.linalg.norm(self.home - data.home)) > 0:
            can &= ((q - data.home) ** 2).sum(axis=1, keepdims=True) - ((q - self.home) ** 2).sum(axis=1, keepdims=True) <= 2 * reach * apart
        return can & (far <= r**2 + bound + np.float32(2 * share) * r * np.sqrt(bound) + np.float32(1e-4))

    def products(self, floor: np.ndarray, data: Block, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows of ``data``, cosine in single precision) of at least ``floor``, which the caller may raise meanwhile."""
        for first in range(0, len(self.n), STRIP):
            last = min(first + STRIP, len(self.n))
            reached = self.reached(first, last, floor, data, share)
            for leaf in np.flatnonzero(reached.any(axis=0)):
                rows = np.flatnonzero(reached[:, leaf]) + first
                at = data.starts[leaf]
                q = self.unit[first:last] if len(rows) == last - first else self.unit[rows]
                s = q @ data.unit[at : data.ends[leaf]].T
                hit = np.flatnonzero(s.max(axis=1) >= floor[rows])
                if len(hit):
                    r, c = np.nonzero(s[hit] >= floor[rows[hit], None])
                    yield rows[hit[r]], c + at, s[hit[r], c]

    def top(self, data: Block, k: int, floor: np.ndarray, share: float, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (to ``digits``, where given) and numbers of the ``k`` best of ``data`` for each row, among those of at least ``floor``; ties to the smaller number."""
        floor = (floor - self.wrong).astype(np.float32)
        best_s, best_n = np.full((len(self.n), k), -np.inf), np.full((len(self.n), k), np.iinfo(np.int64).max)
        held, size = [], 0

        def merge() -> None:
            nonlocal size
            row, col = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = 0
            for part in range(0, len(row), VERIFIED):
                r, c = row[part : part + VERIFIED], col[part : part + VERIFIED]
                sim = self.similarity(r, data, c)
                sim = sim if digits is None else np.round(sim, digits)
                touched = np.unique(r)
                all_r, all_s, all_n = np.concatenate([r, np.repeat(touched, k)]), np.concatenate([sim, best_s[touched].reshape(-1)]), np.concatenate([data.n[c], best_n[touched].reshape(-1)])
                o = np.lexsort((all_n, -all_s, all_r))
                take = o[np.searchsorted(all_r[o], touched)[:, None] + np.arange(k)]
                best_s[touched], best_n[touched] = all_s[take], all_n[take]
                floor[touched] = np.maximum(floor[touched], best_s[touched, -1] - 2 * self.wrong)

        for r, c, _ in self.products(floor, data, share):
            other = self.n[r] != data.n[c]
            held.append((r[other], c[other]))
            size += len(r)
            if size >= VERIFIED:
                merge()
        if held:
            merge()
        return best_s, best_n

    def first_floor(self, k: int) -> np.ndarray:
        """The k-th cosine of each row in its own leaf, itself left out; -1 where the leaf has fewer."""
        out = np.full(len(self.n), -1.0)
        for a, b in zip(self.starts, self.ends):
            if b - a > k:
                for at in range(a, b, STRIP):
                    to = min(b, at + STRIP)
                    s = self.unit[at:to] @ self.unit[a:b].T
                    s[np.arange(to - at), np.arange(at - a, to - a)] = -np.inf
                    out[at:to] = -np.partition(-s, k - 1, axis=1)[:, k - 1] - self.wrong
        return out

    def forest(self, data: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pairs above ``threshold`` that join what all such pairs join, one less than what they join at most."""
        nodes, at = np.unique(np.concatenate([self.n, data.n]), return_inverse=True)
        left, right = at[: len(self.n)], at[len(self.n) :]
        part, out = np.arange(len(nodes)), ([], [])
        for r, c, _ in self.products(np.full(len(self.n), threshold - self.wrong, np.float32), data, 1.0):
            apart = part[left[r]] != part[right[c]]
            r, c = r[apart], c[apart]
            while len(r):
                # One pair of each part at a time: what they join needs no further look.
                _, one = np.unique(part[left[r]], return_index=True)
                tried = np.zeros(len(r), bool)
                tried[one] = True
                for i, j in zip(r[one][ok := self.similarity(r[one], data, c[one]) > threshold], c[one][ok]):
                    a, b = part[left[i]], part[right[j]]
                    if a != b:
                        out[0].append(self.n[i])
                        out[1].append(data.n[j])
                        part[part == b] = a
                apart = ~tried & (part[left[r]] != part[right[c]])
                r, c = r[apart], c[apart]
        return np.array(out[0], np.int64), np.array(out[1], np.int64)


def matrix(raw, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


class Meetings:
    """The classes of equal vectors of a table, in blocks. Vectors must be valid (see ``vectors.invalid_reason``), ids unique and not null.

    members: id, raw. classes: raw, rep (the least id), n (its place among these, so that ties go to the smaller id).
    """

    def __init__(self, df: DataFrame, id_col: str, v: str, block: int = BLOCK, least: int = 4):
        self.kind = kind = "f4" if df.schema[v].dataType.elementType.typeName() == "float" else "f8"
        raw = F.pandas_udf(lambda v: pd.Series([np.asarray(x, kind).tobytes() for x in v]), "binary")
        self.members = written(df.select(F.col(id_col).alias("id"), raw(v).alias("raw")), "vectors")
        self.classes = global_rank(self.members.groupBy("raw").agg(F.min("id").alias("rep")), [F.col("rep")], "n")
        self.total = total = self.classes.count()
        sample = matrix(self.classes.orderBy(F.xxhash64("n")).limit(FIT).select("raw").toPandas()["raw"], kind) if total else np.ones((1, 1), kind)
        unit = (sample / np.linalg.norm(sample.astype(np.float64), axis=1)[:, None]).astype(np.float32)
        spread = np.linalg.eigvalsh(np.cov(unit.T)) if len(unit) > 1 and unit.shape[1] > 1 else np.ones(1)
        #: The number of equally wide dimensions in which vectors are spread as these are.
        self.dimensions = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)) or 1.0
        centres = fitted(unit, max(least if total > least * LEAF else 1, math.ceil(2 * total / block)))

        def cell(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for r in it:
                x = matrix(r, kind)
                yield pd.Series(nearest((x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32), centres).astype(np.int64))

        placed = self.classes.select("n", "raw", F.pandas_udf(cell, "long")("raw").alias("cell"))
        # One row per cell; a cell with more than ``block`` vectors is cut by hash, its parts are blocks numbered from ``first`` on.
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")).orderBy("cell").toPandas()
        first = np.cumsum(sizes["parts"]) - sizes["parts"]
        self.blocks = int(sizes["parts"].sum())
        self.homes = np.repeat(centres[sizes["cell"].to_numpy(int)], sizes["parts"].to_numpy(int), axis=0)
        numbers = df.sparkSession.createDataFrame([(int(c), int(p), int(f)) for c, p, f in zip(sizes["cell"], sizes["parts"], first)], "cell long, parts int, first int")
        self.placed = placed.join(F.broadcast(numbers), "cell").select("n", "raw", (F.col("first") + F.pmod(F.xxhash64("n"), F.col("parts"))).cast("int").alias("block"))

    def packed(self, make) -> DataFrame:
        """A row (block, n, x, starts, centre, own_s, own_n) for each block; the last two are what ``make`` gives for it."""
        kind = self.kind

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            b = Block.of(rows["n"].to_numpy(), matrix(rows["raw"], kind))
            own = make(b)
            return pd.DataFrame([[rows["block"].iloc[0], *(np.ascontiguousarray(x).tobytes() for x in (b.n, b.x, b.starts.astype(np.int64), b.centre.astype(np.float32), *own))]], columns=["block", "n", "x", "starts", "centre", "own_s", "own_n"])

        return written(self.placed.groupBy("block").applyInPandas(pack, "block int, n binary, x binary, starts binary, centre binary, own_s binary, own_n binary"), "blocks")

    def met(self, packed: DataFrame, meet, schema: str, both: bool) -> DataFrame:
        """What ``meet(one, other, row)`` gives for each pair of blocks, or with ``both`` unset for each pair once; a block meets itself, too."""
        kind, homes = self.kind, self.homes
        # One block is one partition, so that a task holds two of them.
        one = packed.repartitionById(max(1, self.blocks), F.col("block"))
        other = one.select(F.col("block").alias("to"), F.col("n").alias("to_n"), F.col("x").alias("to_x"), F.col("starts").alias("to_starts"), F.col("centre").alias("to_centre"))
        pairs = one.join(other.hint("shuffle_replicate_nl"), F.lit(True) if both else F.col("block") <= F.col("to"))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i in range(batch.num_rows):
                    row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                    array = lambda name, t: np.frombuffer(row[name].as_buffer(), t)
                    a, b = (Block(n := array(p + "n", np.int64), array(p + "x", kind).reshape(len(n), -1), array(p + "starts", np.int64), array(p + "centre", np.float32).reshape(-1, homes.shape[1]), homes[row[at].as_py()]) for p, at in (("", "block"), ("to_", "to")))
                    yield pa.RecordBatch.from_pydict(meet(a, b, row["block"].as_py() == row["to"].as_py(), array))

        return pairs.mapInArrow(run, schema)

    def nearest(self, k: int, min_similarity: float = -1.0, share: float = 1.0, digits: int | None = None) -> DataFrame:
        """(q, i, s): at least the ``k`` nearest classes of each class, of at least ``min_similarity``; ``share`` as in :meth:`Block.reached`, 1 loses nothing."""

        def own(b: Block):
            return b.top(b, k, np.maximum(b.first_floor(k), min_similarity), share, digits)

        def meet(a: Block, b: Block, same: bool, array) -> dict:
            s, n = array("own_s", np.float64).reshape(-1, k), array("own_n", np.int64).reshape(-1, k)
            if not same:
                s, n = a.top(b, k, np.maximum(s[:, -1], min_similarity), share, digits)
            r, c = np.nonzero(s >= min_similarity)
            return {"q": a.n[r], "i": n[r, c], "s": s[r, c]}

        near = self.met(self.packed(own), meet, "q long, i long, s double", True)
        return near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "i"))).where(F.col("place") <= k).drop("place")

    def links(self, threshold: float) -> DataFrame:
        """(a, b): pairs of classes above ``threshold`` that join what all pairs above it join."""

        def meet(a: Block, b: Block, same: bool, array) -> dict:
            left, right = a.forest(b, threshold)
            return {"a": left, "b": right}

        return self.met(self.packed(lambda b: (np.empty(0), np.empty(0))), meet, "a long, b long", False)

    def grouped(self, threshold: float) -> DataFrame:
        """(id, component): the least id of what the pairs above ``threshold`` join; equal vectors are one."""
        parts = connected_components(written(self.links(threshold), "links"))
        numbered = self.members.join(self.classes.select("raw", "n").hint("merge"), "raw").select("id", "n")
        found = numbered.join(parts.withColumnRenamed("node", "n").hint("merge"), "n", "left").select("id", F.coalesce("component", "n").alias("n"))
        return found.join(self.classes.select("n", F.col("rep").alias("component")).hint("merge"), "n").select("id", "component")

    def listed(self, near: DataFrame, k: int) -> DataFrame:
        """(id, neighbour, similarity, place): the ``k`` nearest of every id, from those of the classes (q, i, s); equal vectors come first, ties by smaller id."""
        # Of a class of equal vectors the first k + 1 ids can be neighbours.
        numbered = self.members.join(self.classes.select("raw", "n").hint("merge"), "raw").select("id", "n")
        first = numbered.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("id"))).where(F.col("place") <= k + 1).select("n", F.col("id").alias("neighbour"))
        others = near.select("q", F.col("i").alias("n"), "s").join(first.hint("merge"), "n").select(F.col("q").alias("n"), "neighbour", F.col("s").alias("similarity"))
        twins = first.select("n", "neighbour", F.lit(1.0).alias("similarity"))
        found = numbered.join(others.unionByName(twins).hint("merge"), "n").where("id <> neighbour")
        order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "neighbour", "similarity", "place")
