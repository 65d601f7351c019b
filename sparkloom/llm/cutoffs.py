"""Problem 2: the score from which each source keeps a target share of its records.

Scores are coded as integers; a dyadic tree over the codes holds, per source, node and batch, how many records lie below the node.
Batches only add rows of node counts to the stored tree. A target rank is found by descending from the root, all sources at once,
and the leaf that is reached is refined to its distinct scores.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, exists, merged

class ScoreCode(NamedTuple):
    """score -> integer in 0 .. 2^bits - 1, growing with the score: steps of ``width`` from ``low``; scores outside go to the end leaves, which refinement then splits exactly."""

    low: float = 0.0
    width: float = 1.0
    bits: int = 7

    def of(self, score: Column) -> Column:
        step = F.floor((score.cast("double") - F.lit(self.low)) / F.lit(self.width))
        return F.greatest(F.lit(0), F.least(F.lit(2**self.bits - 1), step)).cast("long")


class DyadicTree:
    """A tree of counts at ``path``: parquet rows (batch, source, level, node, n); the counts of a node are the sum over batches.

    Level 0 is the root, level ``bits`` the leaves. Sources and nodes are pre-aggregated before the shuffle, so the stored tree has
    at most 2^(bits+1) rows per source and batch, however many records there are.
    """

    def __init__(self, spark: SparkSession, path: str, code: ScoreCode = ScoreCode()):
        self.spark, self.path, self.code = spark, path, code

    def add(self, rows: DataFrame, source: str, score: str, batch: Column | None = None, sign: int = 1) -> None:
        """Add the node counts of ``rows`` (null sources and null or NaN scores are left out). ``sign`` -1 takes back rows that a later state replaces."""
        leaf = self.code.of(F.col(score))
        known = rows.where(F.col(source).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        leaves = known.groupBy((batch if batch is not None else F.lit("0")).cast("string").alias("batch"), F.col(source).alias("source"), leaf.alias("leaf")).agg((sign * F.count(F.lit(1))).alias("n"))
        levels = F.transform(F.sequence(F.lit(0), F.lit(self.code.bits)), lambda x: F.struct(x.alias("level"), F.call_function("shiftright", F.col("leaf"), self.code.bits - x).alias("node")))
        nodes = leaves.select("batch", "source", "n", F.explode(levels).alias("at")).groupBy("batch", "source", "at.level", "at.node").agg(F.sum("n").alias("n"))
        nodes.coalesce(4).write.mode("append").parquet(self.path)

    def nodes(self) -> DataFrame:
        """(source, level, node, n) over all batches so far."""
        tree = self.spark.read.schema("batch string, source string, level int, node long, n long").parquet(self.path)
        return tree.groupBy("source", "level", "node").agg(F.sum("n").alias("n"))

    def sources(self) -> DataFrame:
        """(source, total, tree): the whole tree of each source as one map of its upper children that hold records, number -> count.

        Nodes are numbered as in a heap, 2^level + node. Only nodes below which a score occurs are stored, so a map has at most as
        many entries as ``bits`` times the distinct codes, 2^bits in all.
        """
        heap = F.lit(1).cast("long") * F.expr("shiftleft(1L, level)") + F.col("node")
        upper = (F.col("n") > 0) & (F.col("level") > 0) & (F.col("node") % 2 == 1)
        entries = F.filter(F.collect_list(F.when(upper, F.struct(heap.alias("at"), F.col("n").alias("n")))), lambda e: e.isNotNull())
        return self.nodes().groupBy("source").agg(F.sum(F.when(F.col("level") == 0, F.col("n"))).alias("total"), F.map_from_entries(entries).alias("tree")).where("total > 0")

    def leaf_of_rank(self, ranks: DataFrame) -> DataFrame:
        """(source, rank, leaf, above) for ``ranks`` (source, rank counted from the greatest score, from 1): the leaf that holds the
        rank and the number of records in greater leaves. Ranks beyond the number of records give no row.

        The stored tree is read once; each row then descends from the root by itself.
        """
        zero = F.lit(0).cast("long")

        def down(at: Column, _: Column) -> Column:
            upper = at["node"] * 2 + 1
            n = F.coalesce(F.try_element_at("tree", upper), zero)
            right = at["above"] + n >= F.col("rank")
            return F.struct(F.when(right, upper).otherwise(at["node"] * 2).alias("node"), F.when(right, at["above"]).otherwise(at["above"] + n).alias("above"))

        start = F.struct(F.lit(1).cast("long").alias("node"), zero.alias("above"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(self.code.bits)), start, down)
        at = ranks.join(bounded_broadcast(self.sources()), "source").where(F.col("total") >= F.col("rank")).withColumn("end", end)
        return at.select("source", "rank", (F.col("end.node") - F.lit(2**self.code.bits)).alias("leaf"), F.col("end.above").alias("above"))


class StoredCatalog:
    """A tree and the current rows behind it, kept in one folder and brought up to date batch by batch, also over several sessions.

    A batch holds deliveries (``id``, ``source``, ``score`` and ``order``, the value that decides which state of an id is current). An id's
    new state is added to the tree and the state it replaces is taken back with sign -1; a late older state changes nothing. The
    current rows are written anew with each batch, the tree only grows by the nodes of the batch.
    """

    def __init__(self, spark: SparkSession, path: str, code: ScoreCode = ScoreCode()):
        self.spark, self.path, self.batches = spark, path, 0
        self.tree = DyadicTree(spark, f"{path}/tree", code)
        while exists(spark, f"{path}/rows-{self.batches + 1}/_SUCCESS"):  # a folder of an earlier session is gone on with
            self.batches += 1

    def current(self) -> DataFrame | None:
        """id, source, score, order of the current state of every id; None before the first batch."""
        return self.spark.read.parquet(f"{self.path}/rows-{self.batches}") if self.batches else None

    def add(self, batch: DataFrame) -> None:
        """Take in ``batch`` (id, source, score, order); rows with a null id are dropped, of an id the greatest order counts."""
        before = self.current()
        new = batch.where("id is not null").groupBy("id").agg(F.max_by(F.struct("source", "score", "order"), "order").alias("new"))
        old = before.select("id", F.struct("source", "score", "order").alias("old")) if before is not None else new.select("id", F.col("new").alias("old")).where("false")
        both = merged(new, old, "id", "full")
        wins = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.order") > F.col("old.order")))
        both = both.select("id", F.when(wins, F.col("new")).otherwise(F.col("old")).alias("row"), F.when(wins, F.col("old")).alias("gone"), wins.alias("wins"))
        both.select("id", "row", "gone", "wins").write.parquet(f"{self.path}/states-{self.batches + 1}")
        states = self.spark.read.schema(both.schema).parquet(f"{self.path}/states-{self.batches + 1}")
        states.select("id", "row.*").write.parquet(f"{self.path}/rows-{self.batches + 1}")
        number = F.lit(str(self.batches + 1))
        self.tree.add(states.where("wins").select("row.source", "row.score"), "source", "score", number)
        self.tree.add(states.where("gone is not null").select("gone.source", "gone.score"), "source", "score", number, sign=-1)
        self.batches += 1


def share_cutoffs(tree: DyadicTree, rows: DataFrame, targets: DataFrame, source: str, score: str, target_pct: str) -> DataFrame:
    """(source, target_pct, total, cutoff, kept): per source the greatest score c that occurs such that the records with score >= c
    are at least target_pct per cent of its records with a score.

    ``rows`` must be what the tree holds. A target of 0 or less still keeps the greatest score; a target above 100 per cent, a null
    target and a source without scored records give no row. Targets given twice for a source count once each.
    """
    totals = tree.sources().select("source", "total")
    wanted = targets.select(F.col(source).alias("source"), F.col(target_pct).alias("target_pct")).where("source is not null and target_pct is not null").distinct().join(totals, "source")
    # The least rank r with r >= total * pct / 100, in whole numbers where pct is one.
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("target_pct") / F.lit(100.0) - F.lit(1e-9))).cast("long"))
    leaves = tree.leaf_of_rank(wanted.select("source", "rank").distinct())
    # Refinement: the distinct scores of the reached leaves only.
    inside = rows.select(F.col(source).alias("source"), F.col(score).alias("score"), tree.code.of(F.col(score)).alias("leaf")).where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    scores = inside.join(leaves.select("source", "leaf").distinct(), ["source", "leaf"], "left_semi").groupBy("source", "leaf", "score").agg(F.count(F.lit(1)).alias("n"))
    descending = Window.partitionBy("source", "leaf").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    upto = scores.select("source", "leaf", "score", F.sum("n").over(descending).alias("upto"))
    hit = leaves.join(upto, ["source", "leaf"]).where(F.col("above") + F.col("upto") >= F.col("rank"))
    cut = hit.groupBy("source", "rank").agg(F.max(F.struct("score", (F.col("above") + F.col("upto")).alias("kept"))).alias("at"))
    return wanted.join(cut, ["source", "rank"]).select("source", "target_pct", "total", F.col("at.score").alias("cutoff"), F.col("at.kept").alias("kept"))
