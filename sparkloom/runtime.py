"""Session settings, the shared scratch folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of the rows is joined by broadcast; there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 0.001


def build_session(app: str = "sparkloom", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests, a single machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_sparkloom_dir", None)
        if not path:
            path = spark._sparkloom_dir = tempfile.mkdtemp(prefix="sparkloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and return a scan of it; the table goes when the session's JVM ends, or with :func:`clear`."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes like the tables of :func:`written`."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, where = files_at(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    sc = spark.sparkContext
    sc._sparkloom_tables = [*getattr(sc, "_sparkloom_tables", []), folder]
    return f"{folder}/{name}"


def files_at(spark: SparkSession, path: str):
    """The file system and the path object of ``path``."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = files_at(spark, path)
    return files.exists(where)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far and give their number; results not yet stored can no longer be computed."""
    sc = spark.sparkContext
    paths, sc._sparkloom_tables, sc._sparkloom_loaded = getattr(sc, "_sparkloom_tables", []), [], {}
    for p in paths:
        files, where = files_at(spark, p)
        files.delete(where, True)
    return len(paths)


def loaded(spark: SparkSession, key: str, build) -> DataFrame:
    """The table that ``build()`` gives, built and written once per session and ``key``; every further call is a scan of the same table."""
    sc = spark.sparkContext
    known = sc._sparkloom_loaded = getattr(sc, "_sparkloom_loaded", {})
    if key not in known:
        known[key] = written(build(), "loaded")
    return known[key]


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join of two sides that both grow with the data.

    Without the hint Spark may broadcast a side whose estimate is small: it scales the size of a compressed file by the share of the
    columns that are read, so a column of long texts can be estimated far below its size and end up on the driver. Skewed keys
    are split by the adaptive skew join.
    """
    return left.join(right.hint("merge"), on, how)


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE) -> DataFrame:
    """Keys of ``counts`` (one row per key with its row count ``n``) that hold at least ``share`` of all rows: 1/share rows at most."""
    return counts.where(F.col(n) >= counts.agg(F.sum(n)).scalar() * share).select(key)


def join_by_key(rows: DataFrame, per_key: DataFrame, counts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per key, where a single key may hold a large part of ``rows``.

    Hot keys (by ``counts``: key, n) are few by construction, so their part of ``per_key`` is broadcast and the hot rows
    are never shuffled; all other keys take an ordinary shuffled join. ``how`` is inner or left. Null keys match nothing.
    """
    # Collected on the driver: 1/HOT_SHARE keys at most.
    hot = [r[0] for r in hot_keys(counts.where(F.col(key).isNotNull()), key).collect()]
    if not hot:
        return rows.join(per_key, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(per_key.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(per_key.where(~is_hot), key, how))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)  # code only, copied by Spark to the workers
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._sparkloom_shipped = True


def bounded_broadcast(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows (counted first), else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def looked_up(rows: DataFrame, table: DataFrame, on, how: str = "inner", limit: int = 100_000) -> DataFrame:
    """``rows`` joined with a table that is often small: by broadcast if it has at most ``limit`` rows (counted first), else by a sort-merge join."""
    small = bounded_broadcast(table, limit)
    return rows.join(small, on, how) if small is not table else merged(rows, table, on, how)
