"""The queries of the training-data problems: name -> callable(spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, scratch, written
from . import capping, cutoffs, leakage, linkage, mixing, neardup, neighbours, reading, residue


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, *columns: str) -> DataFrame:
    """id and ``columns`` of the current row of each id: the greatest scraped_at, then the greatest row_id. Null ids are dropped."""
    latest = F.max_by(F.struct(*columns), F.struct("scraped_at", "row_id")).alias("_row")
    return df.where(F.col("id").isNotNull()).groupBy("id").agg(latest).select("id", *[F.col("_row")[c].alias(c) for c in columns])


#: Problem 1, as TESTDATA.md states it.
NEAR_DUPLICATES = {"shingle": 3, "threshold": 0.6, "min_words": 20}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills whose bodies agree to at least 0.6 on their distinct word triples."""
    return neardup.similar_pairs(neardup.similar_texts(_table(spark, sf_dir, "skills"), "id", "body_markdown", **NEAR_DUPLICATES))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per skill: class of equal bodies, number of linked other bodies, group over links, and the canonical slug of the group
    (earliest first commit, then earliest push, then least id)."""
    rows = current_rows(_table(spark, sf_dir, "skills"), "slug", "body_markdown", "skill_first_commit_at", "repo_pushed_at")
    order = [F.col("skill_first_commit_at"), F.col("repo_pushed_at")]
    return neardup.similar_groups(rows, "id", "body_markdown", order, F.col("slug"), **NEAR_DUPLICATES).withColumnRenamed("canonical", "canonical_slug")


def _p2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(current_rows(_table(spark, sf_dir, "skills"), "entity_type", "quality_score", "quality_tier", "ingested_at"), "p2")
    tree = cutoffs.DyadicTree(spark, scratch(spark, "tree"))
    tree.add(rows, "entity_type", "quality_score", batch=F.to_date("ingested_at"))
    found = cutoffs.share_cutoffs(tree, rows, _table(spark, sf_dir, "keep_targets"), "entity_type", "quality_score", "target_pct")
    # Written once: the descent would run again for each use below.
    return rows, written(found.withColumnRenamed("source", "entity_type"), "cutoffs")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept records of each entity_type with its cutoff."""
    rows, found = _p2(spark, sf_dir)
    kept = rows.join(bounded_broadcast(found.select("entity_type", "cutoff")), "entity_type").where("quality_score >= cutoff")
    return kept.select("entity_type", "cutoff", "id").distinct()


def p2_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity_type: target, scored records, cutoff, kept records, kept share."""
    found = _p2(spark, sf_dir)[1]
    return found.select("entity_type", "target_pct", F.col("total").alias("scored"), "cutoff", "kept", F.round(F.col("kept") * 100.0 / F.col("total"), 3).alias("kept_pct"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoffs as in ``p2_cutoffs``, from deliveries that reach one stored tree in two batches by their time of ingestion:
    the later batch replaces states of the earlier one, and late older states change nothing."""
    rows = _table(spark, sf_dir, "skills").select("id", F.col("entity_type").alias("source"), F.col("quality_score").alias("score"), F.struct("scraped_at", "row_id").alias("order"), "ingested_at")
    middle = rows.agg(F.percentile_approx(F.col("ingested_at").cast("double"), 0.5)).first()[0] or 0.0
    early = F.coalesce(F.col("ingested_at").cast("double") <= F.lit(middle), F.lit(True))
    stored = cutoffs.StoredCatalog(spark, scratch(spark, "catalog"))
    for batch in (rows.where(early), rows.where(~early)):
        stored.add(batch.drop("ingested_at"))
    found = cutoffs.share_cutoffs(stored.tree, stored.current(), _table(spark, sf_dir, "keep_targets").withColumnRenamed("entity_type", "source"), "source", "score", "target_pct")
    return found.select(F.col("source").alias("entity_type"), "target_pct", F.col("total").alias("scored"), "cutoff", "kept")


def p2_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cutoffs compare with quality_tier: scored and kept records of each entity_type and tier as given."""
    rows, found = _p2(spark, sf_dir)
    scored = rows.where("quality_score is not null").join(bounded_broadcast(found.select("entity_type", "cutoff")), "entity_type")
    tier = F.coalesce(F.lower(F.trim("quality_tier")), F.lit("(none)")).alias("quality_tier")
    return scored.groupBy("entity_type", tier).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("quality_score") >= F.col("cutoff")).alias("kept"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of listings with confidence and agreement levels."""
    return linkage.linked_listings(_table(spark, sf_dir, "apis")).withColumn("confidence", F.round("confidence", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings that mean one API."""
    return linkage.linked_listings(_table(spark, sf_dir, "apis")).where("confidence >= 0.5").select("id_a", "id_b")


def p4_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with residue, filler, messages or notices in name or description, with the kinds found and the share of placeholders."""
    rows = _table(spark, sf_dir, "apis").where("id is not null").select("id", residue.residue_kinds(F.col("name")).alias("name_kinds"), residue.residue_kinds(F.col("description")).alias("description_kinds"), F.round(residue.placeholder_density(F.col("description")), 4).alias("placeholder_share"))
    hit = rows.where((F.size("name_kinds") > 0) | (F.size("description_kinds") > 0))
    return hit.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("name_kinds")))).alias("name_kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("description_kinds")))).alias("description_kinds"), F.max("placeholder_share").alias("placeholder_share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the listings to exclude."""
    return p4_listings(spark, sf_dir).select("id")


#: Records that each repository may keep.
REPOSITORY_CAP = 10


def _p5(spark: SparkSession, sf_dir: str) -> capping.Capped:
    rows = current_rows(_table(spark, sf_dir, "skills"), "repo_full_name", "quality_score")
    return capping.cap_per_contributor(rows, capping.repository(F.col("repo_full_name")), F.col("quality_score"), cap=REPOSITORY_CAP)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills left out by the cap on their repository."""
    return _p5(spark, sf_dir).left_out.select("id")


def p5_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog under the cap: id, repository, quality_score."""
    return _p5(spark, sf_dir).kept.select("id", F.col("contributor").alias("repository"), F.col("score").cast("long").alias("quality_score"))


#: Problem 6, as TESTDATA.md states it.
NEIGHBOURS, SIMILAR = 5, 0.86


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of cosine 0.86 or more of which one is among the 5 most similar of the other."""
    found = neighbours.similar_vectors(_table(spark, sf_dir, "skill_vectors"), "id", "values", NEIGHBOURS, SIMILAR).where(F.col("cosine") >= SIMILAR)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector, however similar, with cosine and place."""
    found = neighbours.similar_vectors(_table(spark, sf_dir, "skill_vectors"), "id", "values", NEIGHBOURS, certainty=0.95)
    return found.withColumn("cosine", F.round("cosine", 6)).withColumn("place", F.col("place").cast("long"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that leaked into them: longest equal run, matched and substituted words, share of the item."""
    found = leakage.leaked_passages(_table(spark, sf_dir, "eval_items"), _table(spark, sf_dir, "documents"))
    return found.withColumn("item_share", F.round("item_share", 4))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that share a run of at least 12 words."""
    return p7_leaks(spark, sf_dir).where("run >= 12").select("item_id", "doc_id")


def _p8(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay below their weight although every document is used as often as allowed."""
    return _p8(spark, sf_dir).sources.where("short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aimed and reached share of each source."""
    return _p8(spark, sf_dir).sources


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: documents with their number of copies."""
    return _p8(spark, sf_dir).documents


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of each document with prose, with what it was judged by."""
    return reading.reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as demanding as the level 4 samples."""
    return p9_levels(spark, sf_dir).where("level >= 4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_cutoffs": p2_cutoffs,
    "p2_batches": p2_batches,
    "p2_tiers": p2_tiers,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_listings": p4_listings,
    "p5_found": p5_found,
    "p5_catalog": p5_catalog,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_mixture": p8_mixture,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

_CURRENT = "WITH cur AS (SELECT * FROM skills WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST, row_id DESC) = 1)"
_CUTS = (
    _CURRENT + ", n AS (SELECT entity_type, count(*) AS total FROM cur WHERE quality_score IS NOT NULL GROUP BY 1), "
    "s AS (SELECT entity_type, quality_score, sum(count(*)) OVER (PARTITION BY entity_type ORDER BY quality_score DESC) AS kept FROM cur WHERE quality_score IS NOT NULL GROUP BY 1, 2), "
    "cuts AS (SELECT entity_type, any_value(target_pct) AS target_pct, any_value(total) AS total, max(quality_score) AS cutoff, arg_max(kept, quality_score)::BIGINT AS kept "
    "FROM s JOIN n USING (entity_type) JOIN keep_targets USING (entity_type) WHERE kept * 100 >= target_pct * total GROUP BY 1)"
)
_REPO = r"regexp_replace(regexp_replace(lower(repo_full_name), '^\s+|\s+$', '', 'g'), '\.git$', '')"
_CAP = _CURRENT + f", ranked AS (SELECT id, {_REPO} AS repository, quality_score, row_number() OVER (PARTITION BY {_REPO} ORDER BY quality_score DESC NULLS LAST, id) AS place FROM cur WHERE repo_full_name IS NOT NULL)"

_WORDS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_RUNS = "SELECT DISTINCT {id}, array_to_string(list_slice(w, i, i + {n} - 1), ' ') AS s FROM (SELECT {id}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {t})"
_USABLE = "modal AS (SELECT len(\"values\") AS n FROM skill_vectors WHERE \"values\" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1), v AS (SELECT id, min(\"values\"::DOUBLE[]) AS v FROM skill_vectors, modal WHERE id IS NOT NULL AND len(\"values\") = n AND NOT list_bool_or(list_transform(\"values\", lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_dot_product(\"values\"::DOUBLE[], \"values\"::DOUBLE[]) > 0 GROUP BY 1)"

#: DuckDB's answer to the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "p1_found": f"WITH b AS (SELECT DISTINCT id, {_WORDS.format(c='body_markdown')} AS w FROM skills WHERE id IS NOT NULL AND body_markdown IS NOT NULL), l AS (SELECT id, w FROM b WHERE len(w) >= 20), g AS ({_RUNS.format(id='id', n=3, t='l')}), "
    "n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 10 >= 6 * (x.n + y.n - c)",
    "p6_found": f"WITH {_USABLE}, c AS (SELECT a.id AS q, b.id AS i, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id), t AS (SELECT q, i, s FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) <= 5) SELECT DISTINCT least(q, i) AS id_a, greatest(q, i) AS id_b FROM t WHERE s >= 0.86",
    "p6_neighbours": f"WITH {_USABLE}, c AS (SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id) SELECT id, neighbour, round(s, 6) AS cosine, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS place FROM c QUALIFY place <= 5",
    "p7_found": f"WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), e AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL), x AS ({_RUNS.format(id='doc_id', n=12, t='d')}), y AS ({_RUNS.format(id='item_id', n=12, t='e')}) SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (s)",
    # The answer does not depend on the tokenizer, so characters stand for tokens here.
    "p8_found": "WITH d AS (SELECT source, sum(coalesce(length(text), 0)) AS n FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1) SELECT t.source FROM (SELECT source, max(weight) AS weight, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1) t LEFT JOIN d USING (source) WHERE coalesce(n, 0) * max_repeats < weight * (SELECT sum(n) FROM d)",
    "p2_found": _CUTS + " SELECT entity_type, cutoff, id FROM cur JOIN cuts USING (entity_type) WHERE quality_score >= cutoff",
    "p2_cutoffs": _CUTS + " SELECT entity_type, target_pct, total AS scored, cutoff, kept, round(kept * 100.0 / total, 3) AS kept_pct FROM cuts",
    "p2_batches": _CUTS + " SELECT entity_type, target_pct, total AS scored, cutoff, kept FROM cuts",
    "p2_tiers": _CUTS + " SELECT entity_type, coalesce(lower(trim(quality_tier)), '(none)') AS quality_tier, count(*) AS scored, count(*) FILTER (quality_score >= cutoff) AS kept FROM cur JOIN cuts USING (entity_type) WHERE quality_score IS NOT NULL GROUP BY 1, 2",
    "p5_found": _CAP + f" SELECT id FROM ranked WHERE place > {REPOSITORY_CAP}",
    "p5_catalog": _CAP + f" SELECT id, repository, quality_score FROM ranked WHERE place <= {REPOSITORY_CAP}",
}
