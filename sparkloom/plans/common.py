"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest_per_key

#: Reports are made as of this moment.
AS_OF = "2026-02-01 00:00:00"
CURRENT_SQL = "cur AS (SELECT * FROM skills WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST, row_id DESC) = 1)"
LISTED_SQL = "listed AS (SELECT * FROM apis WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_skills(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current row of each skill id with ``columns``; only these are read."""
    need = list(dict.fromkeys(["id", *columns, "scraped_at", "row_id"]))
    return latest_per_key(table(spark, sf_dir, "skills").select(*need), ["id"], [F.col("scraped_at"), F.col("row_id")])


def current_apis(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    need = list(dict.fromkeys(["id", *columns, "row_id"]))
    return latest_per_key(table(spark, sf_dir, "apis").select(*need), ["id"], [F.col("row_id")])
