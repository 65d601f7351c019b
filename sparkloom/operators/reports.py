"""Report pieces: expectations, zero-filled histograms, ordered count maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(row: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """(rule, broken): one row per rule from a one-row table; 0 means that the rule holds."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), c.cast("long").alias("broken")) for k, c in broken.items()])
    return row.select(F.explode(pairs).alias("r")).select("r.rule", "r.broken")


def enforce(found: DataFrame) -> None:
    """Raise if a rule of :func:`expectations` is broken."""
    bad = [f"{r['rule']}: {r['broken']}" for r in found.where("broken > 0").collect()]
    if bad:
        raise ValueError("broken expectations: " + ", ".join(bad))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, n) of values in 0..1, clamped to the end bins, every bin present; null values are left out."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins))).cast("int")
    n = df.where(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def counts_desc(key: str, n: str) -> Column:
    """Aggregate: array of (key, n) by n descending, then key."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(key).alias("key"))))
    return F.transform(pairs, lambda p: F.struct(p.key.alias("key"), (-p.m).alias("n")))


def index_changes(required: DataFrame, existing: DataFrame, most: int) -> DataFrame:
    """(name, change) of an index plan, both sides (name, kind): create, keep, type_conflict, unplanned; and over_capacity instead of create
    for all that is to be created where that would give more than ``most`` indexes. Kinds compare without case."""
    r, e = required.select("name", F.lower("kind").alias("want")), existing.select("name", F.lower("kind").alias("have"))
    both = r.join(e, "name", "full")
    total = both.agg(F.count(F.lit(1)).alias("n")).scalar()
    change = F.when(F.col("want").isNull(), "unplanned").when(F.col("have").isNull(), F.when(total > most, "over_capacity").otherwise("create")).when(F.col("want") != F.col("have"), "type_conflict").otherwise("keep")
    return both.select("name", change.alias("change"))
