"""Joins between catalog records: containment, co-occurrence, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions


def under(child: Column, parent: Column) -> Column:
    """Whether path ``child`` is ``parent`` or below it; everything is below the empty path."""
    return (parent == "") | (child == parent) | F.startswith(child, F.concat(parent, F.lit("/")))


def contained(parents: DataFrame, children: DataFrame, repo: str, path: str, id_col: str) -> DataFrame:
    """(parent, child): children of the same repository below a parent's path.

    Each child is keyed by every prefix of its path, so that containment is an equi-join; a repository of any size stays spread over
    its folders.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    c = children.where(F.col(repo).isNotNull() & F.col(path).isNotNull()).select(F.col(repo).alias("_repo"), F.col(id_col).alias("child"), F.explode(prefixes).alias("_path"))
    p = parents.where(F.col(repo).isNotNull() & F.col(path).isNotNull()).select(F.col(repo).alias("_repo"), F.col(id_col).alias("parent"), F.regexp_replace(F.col(path), "^/+|/+$", "").alias("_path"))
    return p.join(c, ["_repo", "_path"]).where("parent <> child").select("parent", "child").distinct()


def services_of(df: DataFrame, id_col: str, text: Column, services: dict[str, list[str]]) -> DataFrame:
    """(id, service): the services whose patterns the text mentions; null texts mention none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for service, patterns in services.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | mentions(low, p)
        hits.append(F.when(hit, F.lit(service)))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*hits))).alias("service"))


def co_occurrences(pairs: DataFrame, top: int = 8) -> DataFrame:
    """(service, other, together, place): per service the ``top`` others found with it most often, ties by name.

    A record's services are paired within its own row, so that no join multiplies records; the number of services bounds the pairs.
    """
    sets = pairs.groupBy("id").agg(F.array_sort(F.collect_set("service")).alias("s"))
    rows = sets.select(F.explode("s").alias("service"), "s").select("service", F.explode("s").alias("other")).where("service <> other")
    n = rows.groupBy("service", "other").agg(F.count(F.lit(1)).alias("together"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("together"), "other")).cast("long")).where(F.col("place") <= top)


def growth(snapshots: DataFrame, date: str, key: str, value: str, days: int = 7) -> DataFrame:
    """(key, now, before, delta) between the latest snapshot and the newest one at least ``days`` older, else the oldest of two or more.

    Keys that miss either snapshot, or have a null value there, have no row. Repeats of a key on a date count with their greatest value.
    """
    last = snapshots.agg(F.max(date)).scalar()
    dates = snapshots.select(F.col(date).alias("d")).distinct().withColumn("last", last)
    base = dates.agg(F.coalesce(F.max(F.when(F.col("d") <= F.date_sub("last", days), F.col("d"))), F.min(F.when(F.col("d") < F.col("last"), F.col("d"))))).scalar()
    rows = snapshots.withColumn("last", last).withColumn("base", base).where((F.col(date) == F.col("last")) | (F.col(date) == F.col("base")))
    at = rows.groupBy(key).agg(F.max(F.when(F.col(date) == F.col("last"), F.col(value))).alias("now"), F.max(F.when(F.col(date) == F.col("base"), F.col(value))).alias("before"))
    return at.where(F.col("now").isNotNull() & F.col("before").isNotNull() & F.col(key).isNotNull()).withColumn("delta", F.col("now") - F.col("before"))
