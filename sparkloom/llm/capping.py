"""Problem 5: at most so many records of each contributor, the best ones first.

Parallel bisection: every contributor has bounds on the score of its last kept record; each round counts the records above all
midpoints together and moves one bound of each, until the bounds meet. Ties at the boundary are resolved by identifier.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_in_groups
from ..runtime import join_by_key, written

#: Greatest rank that Spark limits in each task before the shuffle (its default).
GROUP_LIMIT = 1000


class Capped(NamedTuple):
    kept: DataFrame
    left_out: DataFrame


def repository(name: Column) -> Column:
    """One spelling per repository: trimmed, lower-cased, without a final ``.git``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), r"\.git$", "")


def boundary_scores(counts: DataFrame, cap: int, max_rounds: int = 80) -> DataFrame:
    """(contributor, cutoff, above) for each contributor of ``counts`` (contributor, score, n) with more than ``cap`` records.

    cutoff is the score of its cap-th record, above the number of records with a greater score. Null orders last: where fewer than
    ``cap`` records have a score, cutoff is null. Each round is one pre-aggregated pass over ``counts``; a bound snaps to the nearest
    score that occurs, so the bounds meet exactly for scores of any numeric type.
    """
    scored = F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), F.lit(0))
    ends = counts.groupBy("contributor").agg(F.sum("n").alias("total"), scored.alias("scored"), F.min("score").alias("lo"), F.max("score").alias("hi")).where(F.col("total") > cap)
    bounds = written(ends, "bounds")
    done = [bounds.where(F.col("scored") < cap).select("contributor", F.lit(None).cast("double").alias("cutoff"), F.col("scored").alias("above"))]
    open_ = bounds.where(F.col("scored") >= cap).select("contributor", "lo", "hi")
    for _ in range(max_rounds):
        met = F.col("lo") >= F.col("hi")
        done.append(open_.where(met).select("contributor", F.col("lo").alias("cutoff"), F.lit(None).cast("long").alias("above")))
        if open_.where(~met).isEmpty():
            break
        half = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
        mid = open_.where(~met).withColumn("mid", F.when(half < F.col("hi"), half).otherwise(F.col("lo")))
        over = F.col("score") > F.col("mid")
        seen = counts.where("score is not null").join(mid, "contributor").groupBy("contributor").agg(
            F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("above"),
            F.min(F.when(over, F.col("score"))).alias("next"),
            F.max(F.when(~over, F.col("score"))).alias("last"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
        )
        up = F.col("above") >= cap
        open_ = written(seen.select("contributor", F.when(up, F.col("next")).otherwise(F.col("lo")).alias("lo"), F.when(up, F.col("hi")).otherwise(F.col("last")).alias("hi")), "bounds")
    else:
        raise RuntimeError(f"the bounds did not meet in {max_rounds} rounds")
    cutoffs = done[0]
    for d in done[1:]:
        cutoffs = cutoffs.unionByName(d)
    above = counts.join(cutoffs.where("cutoff is not null").select("contributor", "cutoff"), "contributor").where("score > cutoff").groupBy("contributor").agg(F.sum("n").alias("greater"))
    return cutoffs.join(above, "contributor", "left").select("contributor", "cutoff", F.coalesce("above", "greater", F.lit(0)).alias("above"))


def cap_per_contributor(rows: DataFrame, contributor: Column, score: Column, id_col: str = "id", cap: int | None = None, share: float | None = None) -> Capped:
    """Keep, per contributor, the first ``cap`` records by score descending (null and NaN last), then id ascending.

    With ``share`` the cap is that share of the records that have a contributor, rounded down; with both, the smaller one counts.
    ``id_col`` must be unique and not null: rows that repeat an id are counted once, with their greatest score. Records without a
    contributor are in neither result. Both results have (id, contributor, score). An empty table gives empty results.

    A contributor may hold any part of the rows: counts are pre-aggregated, the boundary is joined to hot contributors by
    broadcast (see ``join_by_key``), and of the records tied at a boundary each task passes on at most ``cap``.
    """
    value = score.cast("double")
    rows = rows.select(F.col(id_col).alias("id"), contributor.alias("contributor"), F.when(~F.isnan(value), value).alias("score")).where("id is not null and contributor is not null")
    rows = written(rows.groupBy("id", "contributor").agg(F.max("score").alias("score")), "capping")
    if share is not None:
        limit = int(rows.count() * share)
        cap = limit if cap is None else min(cap, limit)
    if cap is None or cap < 0:
        raise ValueError("cap or share must be given, and not be negative")
    if cap == 0:
        return Capped(rows.where("false"), rows)
    counts = written(rows.groupBy("contributor", "score").agg(F.count(F.lit(1)).alias("n")), "counts")
    per = counts.groupBy("contributor").agg(F.sum("n").alias("n"))
    cutoffs = written(boundary_scores(counts, cap), "cutoffs")
    at = join_by_key(rows, cutoffs, per, "contributor")
    tied = at.where("score <=> cutoff")
    # Up to GROUP_LIMIT places each task passes on no more than that; beyond, Spark would gather a contributor's ties in one task.
    placed = tied.withColumn("place", F.row_number().over(Window.partitionBy("contributor").orderBy("id"))) if cap <= GROUP_LIMIT else rank_in_groups(tied, "contributor", [F.col("id")], "place")
    first = placed.where(F.col("place") <= cap)
    first = written(first.where(F.col("place") <= cap - F.col("above")).select("id", "contributor"), "ties")
    # The last kept id of each boundary: one row per contributor.
    last = first.groupBy("contributor").agg(F.max("id").alias("last_id"))
    at = join_by_key(at, last, per, "contributor", "left")
    out = ((F.col("cutoff").isNotNull() & (F.col("score").isNull() | (F.col("score") < F.col("cutoff")))) | (F.col("score").eqNullSafe(F.col("cutoff")) & (F.col("last_id").isNull() | (F.col("id") > F.col("last_id")))))
    left_out = at.where(out).select("id", "contributor", "score")
    below = join_by_key(rows, cutoffs.withColumn("_capped", F.lit(True)), per, "contributor", "left")
    below = join_by_key(below, last, per, "contributor", "left")
    kept = below.where(F.col("_capped").isNull() | ~out).select("id", "contributor", "score")
    return Capped(kept, left_out)
