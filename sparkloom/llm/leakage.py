"""Problem 7: passages of held-out items inside training texts.

Spaced seeds: a mask over a window of words ignores some of its positions. Every window of an item and of a training text is hashed
under each mask; equal hashes are hits, and around a hit the two word sequences are laid on each other and compared word by word,
so that substituted words neither hide a hit nor end an overlap.

The hashes of both sides meet in a join. So that the windows of the corpus need not be shuffled for it, a filter of bounded size over
the hashes of the items goes to every task first; only windows that pass it leave their task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import looked_up, merged, written
from .hashing import GOLDEN, WORD, WordHashes, mix, slices

#: Fixed masks over windows of twelve words; 0 marks an ignored position.
MASKS = ("110110101011", "101101110011", "111001011101")
#: Bits of the filter for each window of the items, and bits in all at most (32 MB); a fuller filter lets more pass to the join.
WINDOW_BITS, FILTER_BITS = 256, 2**28

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|code|a|mark|small|sub|sup|font|tt|kbd|ins|del|abbr|q)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+[\"'][^\"']*[\"'])?\s*\)|\[([^\[\]]*)\]\[[^\[\]]*\]")
_URL = re.compile(r"<(?:https?|ftp|mailto):[^<>\s]*>")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_ESCAPE = re.compile(r"\\(?:[nrtbf]|u[0-9a-fA-F]{4})")
_NOTE = re.compile(r"\[\^?\d+\]")
_MARKUP = re.compile("[<&\\\\\\[­​-‍⁠﻿]")


def _unescape(m: re.Match) -> str:
    s = m.group()
    return chr(int(s[2:], 16)) if s[1] == "u" else " "


def without_markup(text: str) -> str:
    """``text`` with tags, link targets, note marks, entities, string escapes and invisible characters resolved; words stay as they are."""
    text = _ESCAPE.sub(_unescape, text)
    text = _INVISIBLE.sub("", html.unescape(text))
    text = _URL.sub(" ", text)
    text = _TAG.sub(" ", _INLINE.sub("", text))
    return _NOTE.sub(" ", _LINK.sub(lambda m: m.group(1) or m.group(2) or " ", text))


def variants(text: str) -> list[list[str]]:
    """The word sequences of ``text``: as written, and without markup where that differs."""
    raw = WORD.findall(text.lower())
    if not _MARKUP.search(text):
        return [raw]
    plain = WORD.findall(without_markup(text).lower())
    return [raw] if plain == raw else [raw, plain]


def seed_hashes(words: np.ndarray, sizes: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in ``words``) of each window of len(mask) words inside one text, over the positions the mask keeps."""
    n, salt = len(mask), np.uint64(int(mask, 2) * GOLDEN & (2**64 - 1))
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(text[: len(words) - n + 1] == text[n - 1 :])
    h = np.full(len(at), salt)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                h = mix(h * np.uint64(GOLDEN) + words[at + k])
    return h, at


def _spelled(batch: pa.RecordBatch, hashes: WordHashes, least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of rows (id, text): id and size of every word sequence of ``least`` words or more, and their words one after the other."""
    texts = [(i, v) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for v in variants(t) if len(v) >= least]
    return [i for i, _ in texts], np.array([len(v) for _, v in texts], np.int64), hashes.array([w for _, v in texts for w in v])


_SPELLED = "id long, x long, n int, words binary"


def _spell(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, sizes, words = _spelled(batch, hashes, least)
            raw = [w.tobytes() for w in np.split(words, np.cumsum(sizes)[:-1])] if ids else []
            x = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], names=["id", "x", "n", "words"])

    return run


def _seeds(masks: tuple[str, ...]):
    """(hash, id, x, n, at) of every window of rows ``_SPELLED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64)
            words = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
            starts = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(sizes)), sizes)
            found = [seed_hashes(words, sizes, m) for m in masks]
            h, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            own = text[at] if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[batch.column(k).take(pa.array(own)) for k in range(3)], pa.array((at - starts[own]).astype(np.int32))], names=["hash", "id", "x", "n", "at"])

    return run


def _touched(shared, masks: tuple[str, ...]):
    """Of training texts (id, text) those with windows that pass the filter: ``_SPELLED`` and the hashes and places of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = shared.value
        top = np.uint64(len(bits) * 8 - 1)
        hashes = WordHashes()
        passes = lambda p: (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        for batch in slices(batches):
            ids, sizes, words = _spelled(batch, hashes, len(masks[0]))
            ends = np.cumsum(sizes)
            h, at = [], []
            for mask in masks:
                hash_, place = seed_hashes(words, sizes, mask)
                first = np.flatnonzero(passes(hash_ & top))
                first = first[passes((hash_[first] >> np.uint64(32)) & top) == 1]
                h.append(hash_[first])
                at.append(place[first])
            h, at = np.concatenate(h), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            own = np.searchsorted(ends, at, side="right")
            hit, count = np.unique(own, return_counts=True)
            cut = np.cumsum(count)[:-1]
            raw = [words[ends[d] - sizes[d] : ends[d]].tobytes() for d in hit]
            starts = (ends - sizes)[own] if len(own) else own
            lists = [pa.array(np.split(v, cut) if len(hit) else [], pa.list_(t)) for v, t in ((h.view(np.int64), pa.int64()), ((at - starts).astype(np.int32), pa.int32()))]
            x = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in hit], pa.int64()), pa.array(x), pa.array(sizes[hit], pa.int32()), pa.array(raw, pa.binary()), *lists], names=["id", "x", "n", "words", "hash", "at"])

    return run


def window_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter of ``bits`` bits (a power of two) in which each hash of ``seeds`` has set two. Pre-aggregated by blocks of 4 KB; only they reach the driver."""
    places = seeds.select(F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))).alias("p")).select((F.col("p") + 1).alias("p"))
    blocks = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("block"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        block = np.frombuffer(row["block"], np.uint8)
        out[(row["b"] - 1) * len(block) :][: len(block)] = block[: bits // 8]
    return out


def _stretches(equal: np.ndarray, hits: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """The stretches of ``equal`` around ``hits`` that no more than ``gap`` different words in a row interrupt."""
    same = np.flatnonzero(equal)
    breaks = np.flatnonzero(np.diff(same) > gap + 1)
    first, last = same[np.concatenate([[0], breaks + 1])], same[np.concatenate([breaks, [len(same) - 1]])]
    for k in np.unique(np.clip(np.searchsorted(last, hits), 0, len(last) - 1)):
        yield int(first[k]), int(last[k]) + 1


def _longest(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _verifier(gap: int, min_words: int):
    """Overlaps of rows (item_id, doc_id, item_n, from, hits, doc_words, item_words): the parts that lie on each other, hits counted in the document, which the part enters at ``from``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, doc, n_item, first, hits, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                equal = np.frombuffer(a, np.uint64) == np.frombuffer(b, np.uint64)
                if equal.any():
                    for s, e in _stretches(equal, [p - first for p in sorted(hits)], gap):
                        if e - s >= min_words:
                            n = int(equal[s:e].sum())
                            rows.append((item, doc, e - s, n, _longest(equal[s:e]), n / float(n_item)))
            cols = list(zip(*dict.fromkeys(rows))) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["item_id", "doc_id", "span", "matched", "run", "item_share"])

    return run


def leaked_passages(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", min_words: int = 12, gap: int = 1, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per item and document that overlap: item_id, doc_id, run (longest run of equal words), matched (equal words of the
    best overlap), span (its words), substituted (span - matched), item_share (matched words by the words of the item).

    An overlap starts at a spaced-seed hit and goes on over at most ``gap`` different words in a row; it counts from ``min_words``
    words on. Every run of len(mask) equal words is hit by each mask, so no such run is missed. Case, punctuation, spacing and markup
    do not matter: texts are compared as written and without markup. Ids are integers. Null ids and texts, and texts of fewer
    words than a mask spans, match nothing; equal documents each get their rows. Empty tables give no rows.

    Items and corpus may have any size: the driver sees the filter only (see :func:`window_filter`), the corpus is read once, and of it
    only texts with a window that passes the filter are written and joined, by hash, with the windows of the items. A window that
    many items and texts share costs one row per pair, text and diagonal; what is compared is cut to the size of the item.
    """
    spark = docs.sparkSession
    own = lambda df, i, t: df.where(F.col(i).isNotNull() & F.col(t).isNotNull()).select(F.col(i).cast("long").alias("id"), F.col(t).alias("text"))
    spelled = written(own(items, item_id, item_text).mapInArrow(_spell(len(masks[0])), _SPELLED).dropDuplicates(["id", "x"]), "items")
    seeds = written(spelled.mapInArrow(_seeds(masks), "hash long, id long, x long, n int, at int"), "seeds")
    bits = 2 ** min(FILTER_BITS.bit_length() - 1, max(20, (seeds.count() * WINDOW_BITS).bit_length()))
    shared = spark.sparkContext.broadcast(window_filter(seeds, bits))
    touched = written(own(docs, doc_id, doc_text).mapInArrow(_touched(shared, masks), f"{_SPELLED}, hash array<long>, at array<int>"), "touched")
    hits = touched.select(F.col("id").alias("doc_id"), F.col("x").alias("dx"), F.col("n").alias("doc_n"), F.explode(F.arrays_zip("hash", "at")).alias("h")).select("doc_id", "dx", "doc_n", "h.hash", F.col("h.at").alias("doc_at"))
    asked = seeds.select("hash", F.col("id").alias("item_id"), F.col("x").alias("ix"), F.col("n").alias("item_n"), F.col("at").alias("item_at"))
    met = looked_up(hits, asked, "hash")
    # Place in the text minus place in the item is the same along a diagonal.
    diagonals = met.groupBy("doc_id", "dx", "doc_n", "item_id", "ix", "item_n", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.collect_set("doc_at").alias("hits"))
    begin, end = F.greatest(F.lit(0), F.col("shift")), F.least(F.col("doc_n"), F.col("item_n") + F.col("shift"))
    diagonals = diagonals.withColumn("begin", begin).withColumn("size", (end - F.col("begin")) * 8)
    texts = touched.select(F.col("id").alias("doc_id"), F.col("x").alias("dx"), F.col("words").alias("dw")).dropDuplicates(["doc_id", "dx"])
    laid = merged(diagonals, texts, ["doc_id", "dx"]).withColumn("dw", F.substring("dw", F.col("begin") * 8 + 1, F.col("size")))
    laid = merged(laid, spelled.select(F.col("id").alias("item_id"), F.col("x").alias("ix"), F.col("words").alias("iw")), ["item_id", "ix"])
    laid = laid.select("item_id", "doc_id", "item_n", "begin", "hits", "dw", F.substring("iw", (F.col("begin") - F.col("shift")) * 8 + 1, F.col("size")).alias("iw"))
    found = laid.mapInArrow(_verifier(gap, min_words), "item_id long, doc_id long, span long, matched long, run long, item_share double")
    best = found.groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.max(F.struct("matched", "span", "item_share")).alias("m"))
    return best.select("item_id", "doc_id", "run", "m.matched", "m.span", (F.col("m.span") - F.col("m.matched")).alias("substituted"), "m.item_share")
