"""Keyed choices among rows: latest, best, capped, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_SUFFIX
from ..runtime import join_by_key


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``order`` (nulls lowest); rows with a null key part are dropped.

    One pre-aggregated pass: a key with any number of rows is never gathered.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    known = df.where(" and ".join(f"`{k}` is not null" for k in key))
    return known.groupBy(*key).agg(best).select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in ``order``; each task passes on at most k rows of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def cap_for_type(df: DataFrame, type_col: str, capped: str, k: int, order: list[Column]) -> DataFrame:
    """All rows of other types, and the first ``k`` of type ``capped``."""
    is_capped = F.coalesce(F.col(type_col) == capped, F.lit(False))
    return df.where(~is_capped).unionByName(df.where(is_capped).orderBy(*order).limit(k))


def union_by_precedence(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which, per key, the row of the earliest part wins; columns missing in a part are null. Rows with a null key part are dropped."""
    tagged = [p.withColumn("_part", F.lit(-i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return latest_per_key(out, key, [F.col("_part")]).drop("_part")


def language_variants(df: DataFrame, scope: Column, name: str, score: str, position: str) -> DataFrame:
    """One row per scope and base name (name without a language suffix).

    Reading by ``position``, a row replaces the kept one if its name is the base name or its score is strictly greater. In closed
    form: from the last row with the base name on (or from the start), the greatest score, the earliest on ties. Null scores are 0.
    """
    base = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), LANGUAGE_SUFFIX, "")
    rows = df.withColumn("_scope", scope).withColumn("_base", base).withColumn("_score", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    start = rows.groupBy("_scope", "_base").agg(F.max(F.when(F.col(name) == F.col("_base"), F.col(position))).alias("_from"))
    rows = rows.join(start, rows["_scope"].eqNullSafe(start["_scope"]) & (rows["_base"] == start["_base"])).drop(start["_scope"]).drop(start["_base"])
    rows = rows.where(F.col("_from").isNull() | (F.col(position) >= F.col("_from")))
    return latest_per_key(rows.withColumn("_group", F.struct("_scope", "_base")), ["_group"], [F.col("_score"), -F.col(position)]).select(*df.columns)


def absorb(df: DataFrame, key: str, order: list[Column], fields: list[str], lists: list[str], also: str) -> DataFrame:
    """One row per key: the row with the least ``order`` (ascending, nulls first; should be total), its unknown ``fields`` taken from the next
    that knows them, ``lists`` united in that order, ``also_listed_in`` the other values of column ``also``, sorted, ``merged`` the rows.

    Unknown: null, '' or 'unknown'. Rows with a null key stay as they are. Everything is pre-aggregated, so a key of any size is
    never gathered; of lists and of ``also`` only distinct values are collected.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.where(F.col(key).isNotNull()).withColumn("_order", place)
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "unknown"), F.struct("_order", F.col(c).alias("v")))
    rest = [c for c in df.columns if c != key]
    out = rows.groupBy(key).agg(F.min_by(F.struct(*rest), "_order").alias("_row"), F.count(F.lit(1)).alias("merged"), F.collect_set(also).alias("_also"), *[F.min(known(c))["v"].alias(f"_f_{c}") for c in fields])
    out = out.select(key, *[F.coalesce(f"_f_{c}", F.col("_row")[c]).alias(c) if c in fields else F.col("_row")[c].alias(c) for c in rest], F.array_sort(F.array_except("_also", F.array(F.col("_row")[also]))).alias("also_listed_in"), "merged")
    for c in lists:
        values = rows.select(key, "_order", F.posexplode(c).alias("_p", "_v")).groupBy(key, "_v").agg(F.min(F.struct("_order", "_p")).alias("_at"))
        united = values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("_u"))
        out = out.drop(c).join(united, key, "left").withColumn(c, F.coalesce("_u", F.array().cast(df.schema[c].dataType))).drop("_u")
    loose = df.where(F.col(key).isNull()).withColumn("also_listed_in", F.array().cast("array<string>")).withColumn("merged", F.lit(1).cast("long"))
    return out.select(*df.columns, "also_listed_in", "merged").unionByName(loose)


def suffix_collisions(df: DataFrame, id_col: str, order: list[Column], suffix: Column) -> DataFrame:
    """Ids made unique: all but the row of an id with the least ``order`` (ascending, should be total) get ``~suffix`` behind.

    An id of any size is counted by pre-aggregation and joined back without gathering its rows.
    """
    rows = df.where(F.col(id_col).isNotNull()).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    first = rows.groupBy(id_col).agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("n"))
    out = join_by_key(rows, first.select(id_col, "_first"), first.select(id_col, "n"), id_col)
    out = out.withColumn(id_col, F.when(F.col("_order") > F.col("_first"), F.concat(F.col(id_col), F.lit("~"), suffix)).otherwise(F.col(id_col)))
    return out.select(*df.columns).unionByName(df.where(F.col(id_col).isNull()))


def changed_rows(new: DataFrame, old: DataFrame, key: str, sha: str) -> DataFrame:
    """``new`` with state: added, changed or unchanged against ``old`` by content hash. Null hashes differ from everything."""
    before = old.select(F.col(key).alias("_k"), F.col(sha).alias("_sha")).where("_k is not null").groupBy("_k").agg(F.max("_sha").alias("_sha"))
    return new.join(before, new[key] == before["_k"], "left").withColumn("state", F.when(F.col("_k").isNull(), "added").when(F.coalesce(F.col(sha) == F.col("_sha"), F.lit(False)), "unchanged").otherwise("changed")).drop("_k", "_sha")


def fill_from(df: DataFrame, prior: DataFrame, key: str, columns: list[str], prefer_prior: bool) -> DataFrame:
    """``df`` with ``columns`` filled from ``prior`` (one row per key): prior values win where not null, or only fill nulls."""
    p = prior.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = df.join(p, df[key] == p["_k"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_p_{c}", c) if prefer_prior else F.coalesce(c, f"_p_{c}"))
    return out.select(*df.columns)
