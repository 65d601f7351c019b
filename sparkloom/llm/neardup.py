"""Problem 1: records whose texts differ by small edits.

Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017) fills every one of ``bands * rows`` coordinates: in round i each
shingle is thrown into one bin, a bin keeps what reaches it in the earliest round; after as many rounds as bins the shingle set is
read bin by bin, so that none stays empty. Coordinates are grouped into bands, texts that share a band are candidates, and every
candidate pair is verified on its exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import merged, written
from .hashing import GOLDEN, WordHashes, flatten, mix, shingle_hashes, spaced_words, word_count

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_similarity_sketch(elements: np.ndarray, doc: np.ndarray, n_docs: int, t: int, seed: int = 1) -> np.ndarray:
    """(n_docs, t) sketch of sets given as (element hash, set index). P(two sets agree in a coordinate) = their Jaccard similarity.

    Sets without elements keep the largest value everywhere.
    """
    sketch = np.full(n_docs * t, _EMPTY, np.uint64)
    filled = np.zeros(n_docs, np.int64)
    filled[np.bincount(doc, minlength=n_docs)[:n_docs] == 0] = t
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            live = filled[doc] < t
            if not live.any():
                break
            elements, doc = elements[live], doc[live]
            v = mix(elements ^ mix(np.full(1, (seed * 1_000_003 + i) * GOLDEN & (2**64 - 1), np.uint64)))
            if i < t:
                at = doc * t + (((v >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
            else:
                at = doc * t + (i - t)
            free = sketch[at] == _EMPTY
            at, v = at[free], v[free]
            np.minimum.at(sketch, at, (v << np.uint64(32)) | (v >> np.uint64(32)))
            new = np.unique(at)
            filled += np.bincount(new // t, minlength=n_docs)
    return sketch.reshape(n_docs, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys; equal where all ``rows`` coordinates of a band agree."""
    s = sketch.reshape(len(sketch), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN)), s.shape[:2])
        for r in range(rows):
            key = mix(key * np.uint64(GOLDEN) + s[:, :, r])
    return key.view(np.int64)


def _sketcher(shingle: int, bands: int, rows: int, chunk: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                flat, sizes = flatten(part.column(1).to_pylist(), hashes)
                h, doc = shingle_hashes(flat, sizes, shingle)
                keys = band_keys(fast_similarity_sketch(h, doc, part.num_rows, bands * rows), bands, rows)
                k = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(k)], names=["band", "k"])

    return run


def _verifier(shingle: int, threshold: float):
    def grams(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[i:] for i in range(shingle))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist()
            keep, agreement, last, gb = [], [], None, set()
            for i, (a, b) in enumerate(zip(ta, tb)):
                if b != last:
                    last, gb = b, grams(b)
                ga = grams(a)
                both = len(ga & gb)
                either = len(ga) + len(gb) - both
                if either and both / either >= threshold:
                    keep.append(i)
                    agreement.append(both / either)
            out = batch.select(["ka", "xa", "kb", "xb"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(agreement, pa.float64())], names=["ka", "xa", "kb", "xb", "agreement"])

    return run


class SimilarTexts(NamedTuple):
    """members: one row per record (id, k, x), where (k, x) names its class of equal texts. links: one row per pair of different
    classes (ka, xa, kb, xb, agreement) whose agreement reaches the threshold."""

    members: DataFrame
    links: DataFrame


def similar_texts(df: DataFrame, id_col: str = "id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, min_words: int = 0, bands: int = 64, rows: int = 5) -> SimilarTexts:
    """Classes of equal texts and the links between classes, by sketch, bands and exact verification.

    Agreement = Jaccard similarity of the sets of runs of ``shingle`` words. A pair of agreement s is a candidate with probability
    1-(1-s^rows)^bands (0.6: 0.994, 0.65: 0.9996, 0.8: 1-1e-11 at the defaults); candidates are verified exactly. Copies are
    collapsed before anything is compared, so a group of copies of any size counts as one text, and class pairs are never
    expanded to record pairs here. Rows with a null id or text, with fewer than ``min_words`` or fewer than ``shingle`` words
    have no class; an id given with several texts belongs to each of them. An empty table gives empty tables.

    Shuffles: each text once by class (copies pre-aggregated), ``bands`` keys of 16 bytes per class, the candidate pairs, and
    the left texts of candidates. Every join is a sort-merge join, so no text reaches the driver; hot bands are split by the
    adaptive skew join.
    """
    norm = spaced_words(F.col(text_col))
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), norm.alias("norm"))
    docs = docs.select("id", "norm", F.xxhash64("norm").alias("k"), _second_hash("norm").alias("x"))
    # The word counts are filtered behind an aggregate: pushed below it, the filter would split every text into words twice.
    enough = F.col("n_words") >= max(min_words, shingle)
    members = written(docs.groupBy("id", "k", "x").agg(F.max(word_count(F.col("norm"))).alias("n_words")).where(enough).select("id", "k", "x"), "members")
    # One row per class; two texts under one 64-bit k stay two rows, told apart by x.
    texts = docs.groupBy("k").agg(F.collect_set("norm").alias("norm")).select("k", F.explode("norm").alias("norm"))
    texts = texts.where(word_count(F.col("norm")) >= max(min_words, shingle))
    bands_df = texts.select("k", "norm").mapInArrow(_sketcher(shingle, bands, rows), "band long, k long")
    left, right = bands_df.alias("l"), bands_df.alias("r")
    candidates = merged(left, right, (F.col("l.band") == F.col("r.band")) & (F.col("l.k") < F.col("r.k"))).select(F.col("l.k").alias("ka"), F.col("r.k").alias("kb")).distinct()
    a = texts.select(F.col("k").alias("ka"), F.col("norm").alias("norm_a"))
    b = texts.select(F.col("k").alias("kb"), F.col("norm").alias("norm_b"))
    pairs = merged(merged(candidates, a, "ka"), b, "kb")
    pairs = pairs.select("ka", _second_hash("norm_a").alias("xa"), "kb", _second_hash("norm_b").alias("xb"), "norm_a", "norm_b")
    links = pairs.mapInArrow(_verifier(shingle, threshold), "ka long, xa long, kb long, xb long, agreement double")
    return SimilarTexts(members, links)


def _second_hash(col: str) -> Column:
    return F.xxhash64(F.lit("second"), F.col(col))


def similar_pairs(found: SimilarTexts) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records whose texts are equal or linked. Quadratic in the size of a group, as such a result is."""
    members = found.members
    a = members.select(F.col("id").alias("i"), F.col("k").alias("ka"), F.col("x").alias("xa"))
    b = members.select(F.col("id").alias("j"), F.col("k").alias("kb"), F.col("x").alias("xb"))
    linked = merged(merged(found.links.select("ka", "xa", "kb", "xb"), a, ["ka", "xa"]), b, ["kb", "xb"]).where("i <> j")
    shared = members.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "x")
    copies = merged(members, shared, ["k", "x"])
    same = merged(copies.select(F.col("id").alias("i"), "k", "x"), copies.select(F.col("id").alias("j"), "k", "x"), ["k", "x"]).where("i < j")
    return linked.select("i", "j").union(same.select("i", "j")).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def similar_groups(df: DataFrame, id_col: str, text_col: str, canonical_order: list[Column], canonical: Column, **settings) -> DataFrame:
    """One row per record: id, class_id (least id with the same text), links (linked other texts), group_id (least class_id reached over links), group_size, canonical.

    ``canonical`` is taken from the first record of the group in ``canonical_order`` (nulls last, id last). Records without a class
    (see :func:`similar_texts`) are groups of their own. ``df`` must have one row per id; rows with a null id are dropped.
    """
    found = similar_texts(df, id_col, text_col, **settings)
    classes = found.members.groupBy("k", "x").agg(F.min("id").alias("class_id"))
    links = written(found.links.select("ka", "xa", "kb", "xb"), "links")
    a = classes.select(F.col("k").alias("ka"), F.col("x").alias("xa"), F.col("class_id").alias("a"))
    b = classes.select(F.col("k").alias("kb"), F.col("x").alias("xb"), F.col("class_id").alias("b"))
    edges = written(merged(merged(links, a, ["ka", "xa"]), b, ["kb", "xb"]).select("a", "b"), "edges")
    groups = connected_components(edges)
    degree = edges.select("a").union(edges.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "class_id")
    member = merged(found.members, classes, ["k", "x"]).groupBy("id").agg(F.min("class_id").alias("class_id"))
    order = F.struct(*[x for c in canonical_order for x in (c.isNull(), c)], F.col(id_col))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), order.alias("_order"), canonical.alias("_canonical"))
    rows = merged(rows, member, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    rows = merged(merged(rows, groups.withColumnRenamed("node", "class_id").withColumnRenamed("component", "group_id"), "class_id", "left"), degree, "class_id", "left")
    rows = rows.withColumn("group_id", F.coalesce("group_id", "class_id"))
    per_group = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"), F.min_by("_canonical", "_order").alias("canonical"))
    return merged(rows, per_group, "group_id").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id", "group_size", "canonical")
