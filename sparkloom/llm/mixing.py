"""Problem 8: a mixture of sources with target weights.

Token counts are aggregated to cells of source, language and topic; iterative proportional fitting rakes the cell weights to the
marginals, never above the allowed repeats; documents are then drawn with the calibrated weight of their cell.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, merged, written

TOKENIZER_DIR = "/opt/tokenizers"
#: Up to so many cells are fitted on the driver, more of them by the same steps as Spark aggregates.
DRIVER_CELLS = 100_000


def _counter(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``keep`` and ``tokens``: the number of tokens of ``text`` under a public byte-level BPE vocabulary; null and empty texts have 0.

    ``tokenizer_dir`` must be readable on every executor.
    """
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", tokens long"
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(_counter(f"{tokenizer_dir}/{vocabulary}", pattern), schema)


def rake(cells: pd.DataFrame, targets: dict[str, dict], ceiling: np.ndarray, total: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights per cell (how often its tokens are used) such that each marginal of ``targets`` (column -> value -> share of ``total``) is
    reached as nearly as 0 <= weight <= ceiling allows; the first column of ``targets`` is fitted last and exactly.

    A value of that column whose cells cannot reach its target even at the ceiling is used at the ceiling.
    """
    tokens = cells["tokens"].to_numpy(float)
    weight = np.minimum(1.0, ceiling)
    columns = list(targets)
    codes = {c: pd.factorize(cells[c])[0] for c in columns}
    goals = {}
    for c in columns:
        names = list(dict.fromkeys(cells[c]))
        goals[c] = np.array([targets[c].get(v, np.nan) for v in names]) * total

    def scale(c: str) -> None:
        nonlocal weight
        for _ in range(len(weight) + 1):  # capped cells pass what they cannot take on to the open cells of the same value
            now = np.bincount(codes[c], tokens * weight, minlength=len(goals[c]))
            open_ = weight < ceiling * (1 - 1e-12)
            free = np.bincount(codes[c], tokens * weight * open_, minlength=len(goals[c]))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(now > goals[c], goals[c] / now, np.where(free > 0, (goals[c] - (now - free)) / free, 1.0))
            factor = np.where(np.isfinite(factor) & np.isfinite(goals[c]), np.maximum(factor, 0), 1.0)
            down = (now > goals[c])[codes[c]]
            new = np.minimum(np.where(down | open_, weight * factor[codes[c]], weight), ceiling)
            moved = np.abs(new - weight).max(initial=0)
            weight = new
            if moved < tolerance:
                break

    for _ in range(rounds):
        before = weight.copy()
        for c in [*columns[1:], columns[0]]:
            scale(c)
        if np.abs(weight - before).max(initial=0) < tolerance:
            break
    return weight


def rake_cells(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (the columns of ``goals``, tokens, ceiling) with ``weight``: what :func:`rake` finds, for any number of cells.

    ``goals`` maps a column to its rows (value under the name of the column, goal in tokens); values without a row are left as they are.
    Each scaling is one pre-aggregated pass over the cells and a join with one row per value.
    """
    columns = list(goals)
    cells = written(cells.withColumn("weight", F.least(F.lit(1.0), F.col("ceiling"))), "rake")
    scalings = 2 * cells.count() + 2
    for _ in range(rounds):
        cells = cells.withColumn("_start", F.col("weight"))
        for c in [*columns[1:], columns[0]]:
            for _ in range(scalings):
                size = F.col("tokens") * F.col("weight")
                is_open = F.col("weight") < F.col("ceiling") * (1 - 1e-12)
                sums = cells.groupBy(c).agg(F.sum(size).alias("_now"), F.sum(F.when(is_open, size).otherwise(0.0)).alias("_free"))
                down = F.col("_now") > F.col("goal")
                factor = F.when(down, F.col("goal") / F.col("_now")).when(F.col("_free") > 0, (F.col("goal") - (F.col("_now") - F.col("_free"))) / F.col("_free")).otherwise(1.0)
                sums = sums.join(goals[c], c).select(c, F.greatest(F.lit(0.0), factor).alias("_factor"), down.alias("_down"))
                new = F.least(F.when(F.col("_factor").isNotNull() & (F.col("_down") | is_open), F.col("weight") * F.col("_factor")).otherwise(F.col("weight")), F.col("ceiling"))
                step = written(merged(cells, sums, c, "left").withColumn("_new", new).drop("_factor", "_down"), "rake")
                moved = step.agg(F.max(F.abs(F.col("_new") - F.col("weight")))).first()[0] or 0.0
                cells = step.drop("weight").withColumnRenamed("_new", "weight")
                if moved < tolerance:
                    break
        if (cells.agg(F.max(F.abs(F.col("_start") - F.col("weight")))).first()[0] or 0.0) < tolerance:
            break
        cells = cells.drop("_start")
    return cells.drop("_start")


class Mixture(NamedTuple):
    """documents: doc, source, tokens, copies. sources: one row per target source with what was aimed at and reached."""

    documents: DataFrame
    sources: DataFrame


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str = "doc_kind", total_tokens: int | None = None, seed: int = 42, tokenizer_dir: str = TOKENIZER_DIR, driver_cells: int = DRIVER_CELLS) -> Mixture:
    """Draw documents so that each source of ``targets`` (source, weight, max_repeats) has its weight of the total token size.

    The total is ``total_tokens``, or the size of all documents that have a source. Weights are raked to the source targets and to the
    language and topic shares that the target sources have now; languages are lower-cased, null languages and topics are a value
    of their own. A document of calibrated weight w is used floor(w) times and once more with probability w - floor(w), decided by
    a hash of its id; never more than max_repeats times. Sources that stay below their weight at max_repeats are used fully and
    marked ``short``; their missing part is not given to others, so the reached shares show it. Documents without source, id or
    target are left out (they count in the total if they have a source); documents without text have no size and are not drawn. A null weight or
    max_repeats counts as 0; a source named twice in ``targets`` keeps its greatest weight. Repeated documents are drawn as separate ones.
    ``short`` is read off the fitted weights. Up to ``driver_cells`` cells are fitted on the driver, more by :func:`rake_cells`.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.lower(F.trim(lang)), F.lit("und")).alias("lang"), F.coalesce(F.col(topic).cast("string"), F.lit("none")).alias("topic"), F.col(text).alias("_text")).where("source is not null and doc_id is not null")
    sized = written(count_tokens(rows, "_text", ["doc_id", "source", "lang", "topic"], tokenizer_dir), "tokens")
    cells = written(sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "cells")
    aims = targets.select(F.col("source"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats")).where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    total = float(total_tokens if total_tokens is not None else cells.agg(F.sum("tokens")).first()[0] or 0)
    fit = merged(cells, aims, "source").withColumn("ceiling", F.col("max_repeats").cast("double"))
    fit = written(fit.drop("max_repeats", "weight"), "fit")
    # What the targets leave of the total, and the share of each language and topic in it.
    size = fit.agg(F.sum("tokens")).first()[0] or 0
    left = aims.agg(F.sum("weight")).first()[0] or 0.0
    part = lambda c: fit.groupBy(c).agg((F.sum("tokens") / F.lit(float(max(1, size))) * F.lit(left * total)).alias("goal"))
    goals = {"source": aims.select("source", (F.col("weight") * F.lit(total)).alias("goal")), "lang": part("lang"), "topic": part("topic")}
    spark = docs.sparkSession
    if cells.count() <= driver_cells:
        own = fit.toPandas()
        shares = {c: {r[0]: r[1] / max(total, 1e-300) for r in g.collect()} for c, g in goals.items()}
        own["weight"] = rake(own, shares, own["ceiling"].to_numpy(float), total) if len(own) else []
        schema = "source string, lang string, topic string, tokens long, factor double"
        rows = own.rename(columns={"weight": "factor"})[["source", "lang", "topic", "tokens", "factor"]]
        factors = spark.createDataFrame(rows, schema) if len(own) else spark.createDataFrame([], schema)
    else:
        factors = rake_cells(fit, goals).select("source", "lang", "topic", "tokens", F.col("weight").alias("factor"))
    factors = written(factors, "factors")
    place = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**53)) / F.lit(float(2**53))).cast("double")
    copies = (F.floor("factor") + F.when(place < F.col("factor") - F.floor("factor"), 1).otherwise(0)).cast("long")
    drawn = sized.where("tokens > 0").join(bounded_broadcast(factors.drop("tokens")), ["source", "lang", "topic"]).select("doc_id", "source", "lang", "topic", "tokens", copies.alias("copies")).where("copies > 0")
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    # What the fitted weights give to each source; a source is short where that is below its target.
    fitted = factors.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("factor")).alias("aimed"))
    aimed = F.coalesce("aimed", F.lit(0.0))
    sources = merged(merged(aims, fitted, "source", "left"), reached, "source", "left").select(
        "source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (aimed / F.lit(max(total, 1.0))).alias("aimed_share"), F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), (F.coalesce("reached_tokens", F.lit(0)) / F.lit(max(total, 1.0))).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (aimed < F.col("weight") * F.lit(total) * (1 - 1e-6)).alias("short")
    )
    return Mixture(drawn, sources)
