"""Writers: record files, documents, keyed upserts, budgeted publishing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import changed_rows, latest_per_key
from ..runtime import files_at
from .documents import batches


def write_records(df: DataFrame, path: str, entity_type: str, version: int, generated_at: str) -> None:
    """JSON lines with a header line in a file of its own; the committed folder appears as a whole."""
    header = df.sparkSession.createDataFrame([(json.dumps({"_header": True, "schema_version": version, "entity_type": entity_type, "generated_at": generated_at}),)], "value string")
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    header.coalesce(1).write.mode("append").text(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append JSON lines, which are read after all that is there; a header cannot be appended."""
    if "_header" in df.columns:
        raise ValueError("a header line cannot be appended")
    # Files are read in the order of their names; those of an appended part follow all that are there. Readers pass over names with an underscore.
    now = f"{time.time_ns():020d}"
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/_appended-{now}")
    files, folder = files_at(df.sparkSession, f"{path}/_appended-{now}")
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), folder.getParent().suffix(f"/part-appended-{now}-{name}"))
    files.delete(folder, True)


def write_arrays(df: DataFrame, path: str, rows: int) -> None:
    """Files of one JSON array each, of at most ``rows`` objects."""

    def arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, rows):
            yield pd.DataFrame({"value": ["[" + ",\n".join(part["value"]) + "]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


def document(row: DataFrame, **parts: Column) -> DataFrame:
    """One JSON document from a one-row table."""
    return row.select(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"}).alias("document"))


def feed(items: DataFrame, title: str, home: str, order: list[Column], limit: int = 100) -> DataFrame:
    """One JSON Feed document of the first ``limit`` items (id, url, title, summary, date_published)."""
    top = items.orderBy(*order).limit(limit)
    numbered = top.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    rows = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.struct("id", "url", "title", "summary", "date_published").alias("i")))), lambda x: x.i).alias("items"))
    return document(rows, version=F.lit("https://jsonfeed.org/version/1.1"), title=F.lit(title), home_page_url=F.lit(home), items=F.col("items"))


def registry(df: DataFrame, tiers: list[str], tier: str, columns: list[str], order: list[Column], limit: int = 100_000) -> DataFrame:
    """One JSON document of the records in ``tiers``, at most ``limit`` of them, with their number."""
    top = df.where(F.col(tier).isin(tiers)).orderBy(*order).limit(limit)
    numbered = top.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    rows = numbered.agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", F.struct(*columns).alias("i")))), lambda x: x.i).alias("records"))
    return document(rows, count=F.col("n"), records=F.col("records"))


def publish(df: DataFrame, published: DataFrame, key: str, value: Column, order: list[Column], budget: int) -> tuple[DataFrame, DataFrame]:
    """(to_write, new_published): rows whose value changed since ``published`` (key, sha), the first ``budget`` in ``order``."""
    rows = df.select(F.col(key).alias("key"), value.alias("value"), F.sha2(value, 256).alias("sha"), F.struct(*order).alias("_order"))
    todo = changed_rows(rows, published.select("key", "sha"), "key", "sha").where("state <> 'unchanged'").orderBy("_order", "key").limit(budget).select("key", "value", "sha")
    kept = published.select("key", "sha").join(todo.select("key"), "key", "left_anti")
    return todo, kept.unionByName(todo.select("key", "sha"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``stored`` with ``new`` merged in: of a key the row with the greatest ``order`` stays."""
    return latest_per_key(stored.unionByName(new, allowMissingColumns=True), key, order)


def deliver(df: DataFrame, send: Callable[[list[dict]], None], batch: int = 500, key: str | None = None) -> DataFrame:
    """Send rows in batches to a service; a batch that fails is halved until the bad rows are alone. Gives (row, error) of those: the row is named by ``key``, or as a whole.

    ``send`` runs on the executors and must accept repeats: a lost task sends its rows again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, bad = frame.to_dict("records"), []
            stack = [(a, min(a + batch, len(rows))) for a in range(0, len(rows), batch)]
            while stack:
                a, b = stack.pop()
                try:
                    send(rows[a:b])
                except Exception as e:
                    if b - a == 1:
                        bad.append((str(rows[a][key] if key else rows[a]), str(e)))
                    else:
                        stack += [((a + b) // 2, b), (a, (a + b) // 2)]
            yield pd.DataFrame(bad, columns=["row", "error"])

    return df.mapInPandas(run, "row string, error string")
