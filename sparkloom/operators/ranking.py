"""Global order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import join_by_key, merged, written


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with a 1-based position in ``order``, which should be total (rows that tie get distinct, arbitrary positions).

    Rows are range-partitioned, numbered within their range, and shifted by the sizes of the ranges before: one shuffle, one row per
    range on the driver side, no task that holds everything. The numbered rows are written once, so that a lost task cannot move them.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    own = spread.withColumn("_range", F.spark_partition_id())
    own = written(own.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "ranked")
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    return own.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def rank_in_groups(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a 1-based position within its ``group`` in ``order``, which should be total. Rows with a null group are dropped.

    A group of any size is spread over the range partitions it falls into; each range numbers its own rows, and the sizes of the
    ranges before (one row per group and range) shift them.
    """
    spread = df.where(F.col(group).isNotNull()).repartitionByRange(F.col(group), *order)
    own = spread.withColumn("_range", F.spark_partition_id())
    own = written(own.withColumn("_place", F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))), "ranked")
    sizes = own.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(group, "_range", (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_before"))
    return merged(own, before, [group, "_range"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def percentile_tiers(df: DataFrame, order: list[Column], featured: float = 0.10, solid: float = 0.30, cap: int | None = None) -> DataFrame:
    """``df`` with rank and tier: the first floor(featured * n) rows in ``order`` are featured, the next floor(solid * n) solid, the rest listed.

    With ``cap`` featured is cut to it first, and solid to what is left of it.
    """
    ranked = global_rank(df, order)
    n = ranked.count()
    first = int(n * featured)
    second = int(n * solid)
    if cap is not None:
        first = min(first, cap)
        second = min(second, max(0, cap - first))
    return ranked.withColumn("tier", F.when(F.col("rank") <= first, "featured").when(F.col("rank") <= first + second, "solid").otherwise("listed"))


def round_robin(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, taking one of each source in turn; sources take turns in the order of their best rows."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    rows = df.withColumn("turn", place).where(F.col("turn") <= n)
    return rows.orderBy("turn", *order).limit(n)


def downsample(df: DataFrame, key: list[str], order: list[Column], points: int = 60) -> DataFrame:
    """At most ``points`` rows per key, evenly by position: floor(i * n / points) for i below points, and the last row always."""
    w = Window.partitionBy(*key)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.col("_n") / F.lit(float(points))
    i = F.ceil(F.col("_i") / step)
    near = F.exists(F.array(i - 1, i, i + 1), lambda x: (x >= 0) & (x < points) & (F.floor(x * step) == F.col("_i")))
    return rows.where((F.col("_n") <= points) | near | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def slugs(df: DataFrame, owner: Column, name: str, repo: str, score: str, id_col: str) -> DataFrame:
    """slug per row: owner/name where that is free, else owner/repo-name for all who share it; ``winner`` marks the one of a shared short
    slug to which it redirects: greatest score, then shorter repository name, then repository, then id.

    A short slug of any size is pre-aggregated and joined back without gathering its rows.
    """
    rows = df.withColumn("_owner", owner).withColumn("short", F.concat_ws("/", F.col("_owner"), F.col(name)))
    order = F.struct(F.col(score).isNull().alias("a"), (-F.col(score)).alias("b"), F.length(repo).alias("c"), F.col(repo).alias("d"), F.col(id_col).alias("e"))
    groups = rows.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.min_by(id_col, order).alias("_winner"))
    rows = join_by_key(rows, groups.select("short", F.col("n").alias("_n"), "_winner"), groups.select("short", "n"), "short")
    longer = F.concat_ws("/", "_owner", F.concat_ws("-", F.col(repo), F.col(name)))
    return rows.withColumn("slug", F.when(F.col("_n") > 1, longer).otherwise(F.col("short"))).withColumn("winner", (F.col("_n") > 1) & (F.col(id_col) == F.col("_winner"))).drop("_owner", "_n", "_winner")
