"""Request logs: sessions, reports, limits and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import ASSET_PATHS, ENDPOINT_PATHS, path_like
from ..functions.scoring import percent, session_score
from ..runtime import merged, written


def sessions(log: DataFrame) -> DataFrame:
    """One row per UTC day, ip_hash and user_agent of a request log (ts, ip_hash, user_agent, path, accept, coherent, method, class, asn_class).

    Null keys are a group of their own; class and asn_class are the greatest value. Counts are pre-aggregated, so a client of any size
    is no burden on one task; only distinct paths are exchanged per client.
    """
    asset = path_like(F.col("path"), ASSET_PATHS)
    return log.groupBy(F.to_date("ts").alias("day"), "ip_hash", "user_agent").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("path").alias("paths"), F.count_if(asset).alias("assets"), F.count_if(~asset).alias("content"),
        F.count_if(F.coalesce(F.col("accept").ilike("%text/markdown%"), F.lit(False))).alias("markdown"), F.count_if(path_like(F.col("path"), ENDPOINT_PATHS)).alias("endpoint"),
        F.count_if(F.col("coherent") == 0).alias("incoherent"), F.count_if(F.col("method") == "token_echo").alias("token"), F.count_if(F.col("method") == "mcp").alias("mcp"),
        F.max("class").alias("class"), F.max("asn_class").alias("asn_class"),
    )


SESSION_FIELDS = ["total", "paths", "content", "assets", "markdown", "endpoint", "incoherent", "token", "mcp", "asn_class"]


def scored(s: DataFrame) -> DataFrame:
    """Sessions with score, band, method and single_fetch."""
    out = s.withColumn("_s", session_score({k: F.col(k) for k in SESSION_FIELDS}))
    return out.select(*s.columns, "_s.score", "_s.band", "_s.method", "_s.single_fetch")


def band_report(s: DataFrame) -> DataFrame:
    """One row from scored sessions: totals, bands of the ambiguous ones (class human or unknown), what told them apart, the estimated range."""
    pool = F.col("class").isin("human", "unknown")
    band = lambda b: F.count_if(pool & (F.col("band") == b))
    ratio = F.col("assets") / F.nullif(F.col("assets") + F.col("content"), F.lit(0))
    out = s.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(pool).alias("pool"), band("agent-shaped").alias("agent_shaped"), band("uncertain").alias("uncertain"), band("human-shaped").alias("human_shaped"),
        F.count_if(pool & (F.col("markdown") > 0)).alias("with_markdown"), F.count_if(pool & (F.col("endpoint") > 0)).alias("with_endpoint"), F.count_if(pool & (F.col("incoherent") > 0)).alias("with_incoherent"),
        F.count_if(pool & F.col("single_fetch")).alias("single_fetch"), F.count_if((ratio >= 0.5) & (F.col("incoherent") == 0) & (F.col("asn_class") == "isp_residential")).alias("clearly_human"), F.count_if(F.col("method") == "cooperative").alias("cooperative"),
    )
    return out.withColumn("pct_agent_shaped", percent(F.col("agent_shaped"), F.col("pool"))).withColumn("range_low", F.col("agent_shaped")).withColumn("range_high", F.col("agent_shaped") + F.floor(F.col("uncertain") / 2 + 0.5))


def over_limit(log: DataFrame, key: list[str], at: str, seconds: int, limit: int, order: list[Column]) -> DataFrame:
    """The rows rejected by a tumbling counter: of each key and window of ``seconds``, all after the first ``limit`` in ``order``."""
    window = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    place = F.row_number().over(Window.partitionBy(*key, "_window").orderBy(*order))
    return log.withColumn("_window", window).withColumn("_place", place).where(F.col("_place") > limit).drop("_window", "_place")


def gap_sessions(log: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of rows that lie less than ``gap`` apart."""
    return log.groupBy(key, F.session_window(F.col(at).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(at).cast("timestamp")).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def cache_fetches(log: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, fetches, hits) of a cache whose entries live ``seconds`` from the fetch that made them: a request is a hit while the entry
    lives, else it fetches anew. Rows without key or time are left out.

    Each round finds the next fetch of all keys at once, as a pre-aggregated minimum; there are as many rounds as lifetimes that the log
    spans at most, however many requests a key has.
    """
    rows = written(log.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")), "requests")
    last = written(rows.groupBy("key").agg(F.min("at").alias("from"), F.lit(1).cast("long").alias("fetches"), F.count(F.lit(1)).alias("n")), "fetches")
    done = []
    while not last.isEmpty():
        ends = last.select("key", (F.col("from") + F.lit(seconds * 1_000_000)).alias("end"))
        later = merged(rows, ends, "key").where(F.col("at") >= F.col("end")).groupBy("key").agg(F.min("at").alias("next"))
        step = written(merged(last, later, "key", "left"), "fetches")
        done.append(step.where("next is null").select("key", "fetches", "n"))
        last = step.where("next is not null").select("key", F.col("next").alias("from"), (F.col("fetches") + 1).alias("fetches"), "n")
    out = done[0] if done else last.select("key", "fetches", "n")
    for d in done[1:]:
        out = out.union(d)
    return out.select(F.col("key").alias(key), "fetches", (F.col("n") - F.col("fetches")).alias("hits"))
