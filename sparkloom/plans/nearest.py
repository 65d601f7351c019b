"""Queries over vectors and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import vectors
from ..operators.meetings import Meetings
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_MODAL = "modal AS (SELECT len(\"values\") AS size FROM skill_vectors WHERE \"values\" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)"
_REASON = "CASE WHEN \"values\" IS NULL THEN 'missing' WHEN len(\"values\") <> size THEN 'size' WHEN list_bool_or(list_transform(\"values\", lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'not_finite' WHEN list_sum(list_transform(\"values\", lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 'zero' END"


@query(f"WITH {_MODAL} SELECT id, {_REASON} AS reason, upserted_at FROM skill_vectors, modal")
def vector_validation(spark, d) -> DataFrame:
    v = table(spark, d, "skill_vectors").select("id", "values", "upserted_at")
    size = vectors.modal_size(v, "values").select("size").scalar()
    return v.withColumn("size", size).select("id", vectors.invalid_reason(F.col("values"), F.col("size")).alias("reason"), "upserted_at")


@query(f"WITH {_MODAL} SELECT coalesce({_REASON}, 'usable') AS reason, count(*) AS n, floor(count(*) * 1000.0::DOUBLE / sum(count(*)) OVER () + 0.5) / 10 AS pct FROM skill_vectors, modal GROUP BY 1")
def vector_report(spark, d) -> DataFrame:
    n = vector_validation(spark, d).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("t", n.agg(F.sum("n")).scalar()).select("reason", "n", (F.floor(F.col("n") * 1000.0 / F.col("t") + 0.5) / 10).alias("pct"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def unit_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.round(vectors.length(F.col("embedding")), 6).alias("length"), F.round(vectors.unit(F.col("embedding"))[0], 6).alias("first"))


_SIM = "sims AS (SELECT a.vec_id, b.vec_id AS neighbour, round(array_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(f"WITH {_SIM} SELECT vec_id, neighbour, floor(similarity * 10000 + 0.5) / 10000 AS similarity FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 3")
def exact_top3(spark, d) -> DataFrame:
    near = vectors.exact_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 3)
    return near.select(F.col("id").alias("vec_id"), "neighbour", (F.floor(F.round("similarity", 6) * 10000 + 0.5) / 10000).alias("similarity"))


#: One setting for ``hashed_top3`` and the recall that vouches for it. The neighbours here are far (cosine 0.3 to 0.5), so buckets are wide.
HASHED = {"tables": 24, "bits": 4}


def _hashed(e: DataFrame) -> DataFrame:
    return vectors.hashed_neighbours(e, "vec_id", "embedding", 3, **HASHED)


def hashed_top3(spark, d) -> DataFrame:
    """Approximate neighbours: rows only; their recall is a test and ``hashed_recall`` below."""
    near = _hashed(table(spark, d, "embeddings"))
    return near.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "place")


QUERIES["hashed_top3"] = hashed_top3


@query("SELECT true AS no_wrong_pair, true AS most_found")
def hashed_recall(spark, d) -> DataFrame:
    """Of exactly what ``hashed_top3`` returns: the share of all true top 3, and of those above 0.4."""
    e = table(spark, d, "embeddings")
    r = vectors.recall(vectors.exact_neighbours(e, "vec_id", "embedding", 3), _hashed(e), 0.4)
    return r.select((F.col("wrong") == 0).alias("no_wrong_pair"), (F.least("overlap", "pair_recall") >= 0.9).alias("most_found"))


@query(
    "WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "edge AS (SELECT a, b FROM e WHERE s > 0.4), reach(node, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.node), part AS (SELECT node, min(c) AS component FROM reach GROUP BY 1), top AS (SELECT a, max(s) AS s FROM e GROUP BY 1) "
    "SELECT p.node AS id, component, component AS canonical, p.node <> component AS is_duplicate, round(greatest(0, least(1, 1 - s)), 6) AS novelty FROM part p JOIN top ON top.a = p.node"
)
def near_duplicate_vectors(spark, d) -> DataFrame:
    out = vectors.near_duplicates(table(spark, d, "embeddings"), "vec_id", "embedding", [F.col("vec_id")], threshold=0.4, recall=1)
    return out.withColumn("novelty", F.round("novelty", 6))


def indexed_top3(spark, d) -> DataFrame:
    """Approximate neighbours by probed cells: rows only; ``index_gates`` measures exactly this."""
    near = vectors.indexed_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 3)
    return near.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "place")


def index_gates(spark, d) -> DataFrame:
    """What the index loses against brute force over all vectors: measured values, so rows only. It should reach a pair recall of 0.995
    above the threshold, a flap below 0.005, and 0.95 of the neighbours and of the novel ids."""
    e = table(spark, d, "embeddings")
    return vectors.gates(vectors.exact_neighbours(e, "vec_id", "embedding", 3), vectors.indexed_neighbours(e, "vec_id", "embedding", 3, recall=0.999), 0.4)


QUERIES["indexed_top3"], QUERIES["index_gates"] = indexed_top3, index_gates
_USABLE = _MODAL + ", v AS (SELECT id, metadata.slug AS slug, \"values\"::DOUBLE[] AS v FROM (SELECT *, " + _REASON + " AS reason FROM skill_vectors, modal) WHERE reason IS NULL AND id IS NOT NULL)"


def _usable(spark, d) -> DataFrame:
    """id, slug, values of the usable vectors."""
    v = table(spark, d, "skill_vectors").where("id is not null").select("id", F.col("metadata.slug").alias("slug"), "values")
    size = vectors.modal_size(v, "values").select("size").scalar()
    return v.withColumn("size", size).where(vectors.invalid_reason(F.col("values"), F.col("size")).isNull()).select("id", "slug", "values")


@query(
    f"WITH RECURSIVE {_USABLE}, u AS (SELECT id, min(v) AS v FROM v GROUP BY 1), edge AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) > 0.9), "
    "reach(node, c) AS (SELECT id, id FROM u UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.node), part AS (SELECT node, min(c) AS component FROM reach GROUP BY 1) SELECT node AS id, component, node <> component AS is_duplicate FROM part"
)
def duplicate_records(spark, d) -> DataFrame:
    """Groups of records whose vectors are nearly the same: all pairs above the threshold count."""
    rows = _usable(spark, d).groupBy("id").agg(F.min("values").alias("values"))
    return Meetings(rows, "id", "values").grouped(0.9).select("id", "component", (F.col("id") != F.col("component")).alias("is_duplicate"))


@query(f"WITH {_USABLE}, u AS (SELECT min(id) AS id, slug, arg_min(v, id) AS v FROM v WHERE slug IS NOT NULL GROUP BY slug), s AS (SELECT a.slug, b.slug AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.slug <> b.slug) SELECT slug, neighbour, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY slug ORDER BY round(s, 12) DESC, neighbour) <= 3")
def similar_items(spark, d) -> DataFrame:
    """The 3 nearest of each slug among the first record of every other slug, so that twins of a slug take no place."""
    rows = _usable(spark, d).where("slug is not null").groupBy("slug").agg(F.min_by("values", "id").alias("values"))
    all_pairs = Meetings(rows, "slug", "values")
    near = all_pairs.listed(all_pairs.nearest(3, digits=12), 3)
    return near.select(F.col("id").alias("slug"), "neighbour", F.round("similarity", 6).alias("similarity"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(array_cosine_similarity(embedding::DOUBLE[64], q::DOUBLE[64]), 6) AS score FROM embeddings, q WHERE label <> 2), b AS (SELECT label, arg_max(vec_id, score) AS vec_id, max(score) AS score FROM s GROUP BY 1) SELECT vec_id, label, floor(score * 10000 + 0.5) / 10000 AS score FROM b ORDER BY b.score DESC, vec_id LIMIT 5")
def semantic_search(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").scalar()
    s = e.where("label <> 2").withColumn("q", q).select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    best = s.groupBy("label").agg(F.max_by("vec_id", "score").alias("vec_id"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", "label", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def cluster_report(spark, d) -> DataFrame:
    """k-means is iterative, so rows only: size, dominant label and its share of each cluster."""
    e = table(spark, d, "embeddings")
    c = vectors.clusters(e, "vec_id", "embedding", 8).withColumnRenamed("id", "vec_id").join(e.select("vec_id", "label"), "vec_id")
    n = c.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    return out.select("cluster", "size", (-F.col("m.l")).alias("dominant"), F.round(F.col("m.n") * 100.0 / F.col("size"), 1).alias("pct"))


QUERIES["cluster_report"] = cluster_report


@query("SELECT text_sha, count(*) AS copies, min(doc_id) AS first FROM (SELECT sha256(text) AS text_sha, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, d) -> DataFrame:
    r = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return r.where("copies > 1")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)<script[^>]+type=[\"'']application/ld\\+json[\"'']')) AS json_ld, contains(lower(text), 'schema.org') AS schema_org, regexp_matches(text, '(?i)^\\s*(<!doctype html|<html)') AS html, len(regexp_extract_all(text, '\\]\\(https?://')) AS links FROM documents WHERE text IS NOT NULL")
def page_signals(spark, d) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.json_ld_scripts(t).cast("long").alias("json_ld"), F.contains(F.lower(t), F.lit("schema.org")).alias("schema_org"), t.rlike(r"(?i)^\s*(<!doctype html|<html)").alias("html"), F.regexp_count(t, F.lit(r"\]\(https?://")).cast("long").alias("links"))


@query("WITH w AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 6)) AS words FROM documents WHERE text IS NOT NULL), b AS (SELECT list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY item_id)), '[^a-z0-9]+'), lambda x: length(x) > 6)) AS words FROM eval_items) SELECT doc_id, CASE WHEN len(list_distinct(list_concat(w.words, b.words))) > 0 THEN round(len(list_intersect(w.words, b.words)) / len(list_distinct(list_concat(w.words, b.words))), 6) ELSE 0 END::DOUBLE AS jaccard FROM w, b")
def jaccard_to_items(spark, d) -> DataFrame:
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 6))
    # The evaluation items are a table of fixed size; their words are one row.
    b = table(spark, d, "eval_items").select(F.explode(long(F.col("text"))).alias("w")).agg(F.collect_set("w")).scalar()
    w = table(spark, d, "documents").where("text is not null").select("doc_id", long(F.col("text")).alias("own"))
    share = F.size(F.array_intersect("own", "words")) / F.size(F.array_union("own", "words"))
    return w.withColumn("words", b).select("doc_id", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("jaccard"))
