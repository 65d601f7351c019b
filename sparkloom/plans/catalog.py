"""Queries over the catalog of skills: rules, scores, tiers, slugs, feeds, roll-ups, links. Each stands beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scoring, text
from ..operators import dedup, links, ranking
from .common import AS_OF, CURRENT_SQL, current_skills, table

QUERIES, ORACLES = {}, {}
WITH = "WITH " + CURRENT_SQL
TS = f"TIMESTAMPTZ '{AS_OF}+00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _reason_sql() -> str:
    names = ", ".join(f"'{n}'" for n in rules.TEMPLATE_NAMES)
    like = lambda c, ps: f"regexp_matches(lower(coalesce({c}, '')), '{'|'.join(f'(?:{p})' for p in ps)}')"
    return f"""CASE WHEN lower(coalesce(name, '')) IN ({names}) THEN 'template_name' WHEN {like('description', rules.PLACEHOLDER_STARTS)} THEN 'placeholder_description' WHEN {like('name', rules.HOLLOW_NAMES)} THEN 'hollow_name'
      WHEN entity_type = 'skill' THEN CASE WHEN coalesce(body_length, 0) < 200 THEN 'short_body' WHEN coalesce(name, '') = '' AND coalesce(description, '') = '' THEN 'anonymous' END
      WHEN entity_type IN ('plugin', 'mcp_server') THEN CASE WHEN length(trim(coalesce(description, ''))) < 30 THEN 'short_description' END END"""


@query(WITH + " SELECT id, row_id, slug, name, quality_score, scraped_at FROM cur")
def latest_wins(spark, d) -> DataFrame:
    return current_skills(spark, d, "slug", "name", "quality_score").select("id", "row_id", "slug", "name", "quality_score", "scraped_at")


@query(WITH + f" SELECT id, entity_type, {_reason_sql()} AS reason FROM cur")
def slop_filter(spark, d) -> DataFrame:
    rows = current_skills(spark, d, "entity_type", "name", "description", "body_length")
    return rows.select("id", "entity_type", rules.drop_reason(F.col("entity_type"), ["skill", "plugin", "mcp_server"]).alias("reason"))


@query(WITH + f" SELECT entity_type, coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT entity_type, {_reason_sql()} AS reason FROM cur) GROUP BY 1, 2")
def drop_reason_counts(spark, d) -> DataFrame:
    return slop_filter(spark, d).groupBy("entity_type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _flags_sql(body: str, flags: dict) -> str:
    each = ", ".join(f"CASE WHEN {'contains(lower(coalesce(' + body + ', chr(0))), ' + repr(t) + ') AND ' if t else ''}regexp_matches(coalesce({body}, ''), '{p}') THEN '{n}' END" for n, (t, p) in flags.items())
    return f"list_sort(list_filter([{each}], lambda x: x IS NOT NULL))"


#: The production rules hit nothing in clean text, so these, over the same operator, are run on the documents as well.
TEXT_RULES = {"code_fence": ("```", "```"), "table_row": ("|", r"\|\s*[a-z]+\s*\|"), "link": ("http", r"https?://[a-z0-9.]+"), "shell": ("", r"(?i)\b(?:pip|npm|cargo)\s+install\b"), "question": ("?", r"\?\s*$")}


@query(f"SELECT doc_id, {_flags_sql('text', {**rules.CONTENT_RULES, **TEXT_RULES})} AS flags FROM documents")
def content_flags(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.content_flags(F.col("text"), {**rules.CONTENT_RULES, **TEXT_RULES}).alias("flags"))


@query(f"WITH f AS (SELECT {_flags_sql('text', {**rules.CONTENT_RULES, **TEXT_RULES})} AS flags FROM documents) SELECT flag, count(*) AS docs, count(*) FILTER (m) AS with_others FROM (SELECT unnest(flags) AS flag, len(flags) >= 2 AS m FROM f) GROUP BY 1")
def flag_stats(spark, d) -> DataFrame:
    rows = content_flags(spark, d).select(F.explode("flags").alias("flag"), (F.size("flags") >= 2).alias("m"))
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("docs"), F.count_if("m").alias("with_others"))


_DAYS = f"(epoch({TS}) - epoch(try_cast(repo_pushed_at AS TIMESTAMPTZ))) / 86400.0"
_SIGNALS = f"""SELECT id, CASE WHEN repo_stars > 0 THEN least(100, floor(log10(repo_stars + 1) * 33.3 + 0.5)) ELSE 0 END::BIGINT AS stars,
  CASE WHEN {_DAYS} IS NULL THEN 0 WHEN {_DAYS} <= 7 THEN 100 WHEN {_DAYS} <= 30 THEN 90 WHEN {_DAYS} <= 90 THEN 75 WHEN {_DAYS} <= 180 THEN 50 WHEN {_DAYS} <= 365 THEN 25 ELSE 5 END AS recency,
  least(100, CASE WHEN length(name) > 0 THEN 30 ELSE 0 END + CASE WHEN length(description) > 10 THEN 40 WHEN length(description) > 0 THEN 20 ELSE 0 END + CASE WHEN len(tags) >= 3 THEN 30 WHEN len(tags) >= 1 THEN 15 ELSE 0 END) AS main,
  least(100, CASE WHEN body_length > 2000 THEN 50 WHEN body_length > 500 THEN 35 WHEN body_length > 100 THEN 20 ELSE 5 END + CASE WHEN length(description) > 20 THEN 30 WHEN length(description) > 0 THEN 15 ELSE 0 END + CASE WHEN length(description) > 50 THEN 20 WHEN length(description) > 0 THEN 10 ELSE 0 END) AS docs,
  CASE WHEN coalesce(repo_open_issues, 0) = 0 THEN 80 WHEN repo_stars > 0 THEN CASE WHEN repo_open_issues / repo_stars < 0.05 THEN 90 WHEN repo_open_issues / repo_stars < 0.1 THEN 75 WHEN repo_open_issues / repo_stars < 0.3 THEN 50 WHEN repo_open_issues / repo_stars < 0.5 THEN 30 ELSE 10 END
    WHEN repo_open_issues > 10 THEN 20 WHEN repo_open_issues > 5 THEN 40 ELSE 60 END AS issues,
  CASE WHEN repo_license IS NULL OR repo_license IN ('', 'NOASSERTION') THEN 0 WHEN repo_license IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'Unlicense', '0BSD') THEN 100 ELSE 70 END AS license,
  CASE WHEN coalesce(length(description), 0) > 50 THEN 100 WHEN coalesce(length(description), 0) > 20 THEN 60 WHEN coalesce(length(description), 0) > 0 THEN 30 ELSE 0 END AS description FROM cur"""


@query(WITH + f", s AS ({_SIGNALS}) SELECT *, floor(least(100, stars * 0.20::DOUBLE + recency * 0.20::DOUBLE + main * 0.20::DOUBLE + docs * 0.15::DOUBLE + issues * 0.10::DOUBLE + license * 0.10::DOUBLE + description * 0.05::DOUBLE) + 0.5)::BIGINT AS score FROM s")
def quality_scores(spark, d) -> DataFrame:
    r = current_skills(spark, d, "name", "description", "tags", "body_length", "repo_stars", "repo_open_issues", "repo_license", "repo_pushed_at")
    c = F.col
    signals = {
        "stars": scoring.stars(c("repo_stars")),
        "recency": scoring.recency(c("repo_pushed_at"), AS_OF),
        "main": scoring.frontmatter(c("name"), c("description"), F.size("tags")),
        "docs": scoring.docs(c("body_length"), c("description"), c("description")),
        "issues": scoring.issues(c("repo_open_issues"), c("repo_stars")),
        "license": scoring.license_score(c("repo_license")),
        "description": scoring.description_score(c("description")),
    }
    return r.select("id", *[s.alias(k) for k, s in signals.items()], scoring.weighted(signals, scoring.RECORD_WEIGHTS).alias("score"))


def _tier_order():
    return [F.desc_nulls_last("quality_score"), F.desc("stars"), F.asc("id")]


def _tier_sql(cap: int | None) -> str:
    a, b = "floor(0.10::DOUBLE * n)", "floor(0.30::DOUBLE * n)"
    if cap is not None:
        a, b = f"least({a}, {cap})", f"least({b}, greatest(0, {cap} - least({a}, {cap})))"
    return WITH + f", r AS (SELECT id, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, coalesce(repo_stars, 0) DESC, id) AS rank, count(*) OVER () AS n FROM cur) SELECT id, rank, CASE WHEN rank <= {a} THEN 'featured' WHEN rank <= {a} + {b} THEN 'solid' ELSE 'listed' END AS tier FROM r"


def _tiers(spark, d, cap=None) -> DataFrame:
    rows = current_skills(spark, d, "quality_score", "repo_stars").select("id", "quality_score", F.coalesce("repo_stars", F.lit(0)).alias("stars"))
    return ranking.percentile_tiers(rows, _tier_order(), cap=cap).select("id", "rank", "tier")


@query(_tier_sql(None))
def percentile_tiers(spark, d) -> DataFrame:
    return _tiers(spark, d)


@query(_tier_sql(200))
def tier_capped(spark, d) -> DataFrame:
    return _tiers(spark, d, 200)


@query("WITH t AS (" + _tier_sql(None) + ") SELECT tier, count(*) AS n FROM t GROUP BY 1")
def tier_counts(spark, d) -> DataFrame:
    return _tiers(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + " SELECT id, CASE WHEN quality_score >= 80 THEN 'featured' WHEN quality_score >= 50 THEN 'solid' ELSE 'listed' END AS tier, lower(trim(quality_tier)) AS stored FROM cur")
def threshold_tiers(spark, d) -> DataFrame:
    tier = F.when(F.col("quality_score") >= 80, "featured").when(F.col("quality_score") >= 50, "solid").otherwise("listed")
    return current_skills(spark, d, "quality_score", "quality_tier").select("id", tier.alias("tier"), F.lower(F.trim("quality_tier")).alias("stored"))


def _category_sql() -> str:
    body = "lower(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(array_to_string(tags, ' '), '')))"
    parts = []
    for words in text.CATEGORIES.values():
        parts.append(" + ".join(f"CASE WHEN contains(t, '{w}') THEN CASE WHEN contains(nm, '{w}') THEN 3 ELSE 1 END ELSE 0 END" for w in words.split()))
    names = ", ".join(f"'{c}'" for c in text.CATEGORIES)
    return WITH + f", x AS (SELECT id, {body} AS t, lower(coalesce(name, '')) AS nm FROM cur), s AS (SELECT id, [{', '.join(parts)}] AS s FROM x) SELECT id, CASE WHEN list_max(s) > 0 THEN ([{names}])[list_position(s, list_max(s))] ELSE '{text.DEFAULT_CATEGORY}' END AS category FROM s"


@query(_category_sql())
def categorize(spark, d) -> DataFrame:
    return current_skills(spark, d, "name", "description", "tags").select("id", text.categorize(F.col("name"), F.col("description"), F.array_join("tags", " ")).alias("category"))


@query("WITH c AS (" + _category_sql() + ") SELECT category, regexp_replace(regexp_replace(lower(replace(category, '&', 'and')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, count(*) AS n FROM c GROUP BY 1, 2")
def category_counts(spark, d) -> DataFrame:
    return categorize(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", text.category_slug(F.col("category")).alias("slug"), "n")


_VARIANT_BASE = "regexp_replace(coalesce(name, ''), '(?i)-(ar|de|es|fr|ja|ko|pt|ru|zh|zh-cn|zh-tw|zhs|zht|it|nl|pl|tr|hi|id|vi|th|sv|da|no|fi|cs|el|he|uk)$', '')"


@query(
    "WITH v AS (SELECT doc_id, source, concat_ws('-', repo_full_name, lower(lang)) AS name, n_chars FROM documents), "
    f"b AS (SELECT *, {_VARIANT_BASE} AS base FROM v), p AS (SELECT *, max(CASE WHEN name = base THEN doc_id END) OVER (PARTITION BY source, base) AS p0 FROM b) "
    "SELECT doc_id, source, name FROM p WHERE p0 IS NULL OR doc_id >= p0 QUALIFY row_number() OVER (PARTITION BY source, base ORDER BY coalesce(n_chars, 0) DESC, doc_id) = 1"
)
def variant_dedup(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.concat_ws("-", "repo_full_name", F.lower("lang")).alias("name"), "n_chars")
    return dedup.language_variants(rows, F.col("source"), "name", "n_chars", "doc_id").select("doc_id", "source", "name")


_REPO = r"regexp_replace(regexp_replace(lower(repo_full_name), '^\s+|\s+$', '', 'g'), '\.git$', '')"


def repo(c="repo_full_name"):
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\.git$", "")


@query(WITH + f" SELECT {_REPO} AS repository, id, quality_score FROM cur WHERE repo_full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_REPO} ORDER BY quality_score DESC NULLS LAST, id) = 1")
def best_per_repository(spark, d) -> DataFrame:
    rows = current_skills(spark, d, "repo_full_name", "quality_score").select(repo().alias("repository"), "id", "quality_score").where("repository is not null")
    return dedup.first_per_key(rows, ["repository"], [F.desc_nulls_last("quality_score"), F.asc("id")])


@query(WITH + " SELECT slug, id, quality_score FROM cur WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY quality_score DESC NULLS LAST, id) = 1")
def best_per_slug(spark, d) -> DataFrame:
    rows = current_skills(spark, d, "slug", "quality_score").where("slug is not null").select("slug", "id", "quality_score")
    return dedup.first_per_key(rows, ["slug"], [F.desc_nulls_last("quality_score"), F.asc("id")])


@query(WITH + f" SELECT {_REPO} AS repository, id FROM cur WHERE repo_full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_REPO} ORDER BY id) <= 3")
def capped_paths(spark, d) -> DataFrame:
    rows = current_skills(spark, d, "repo_full_name").select(repo().alias("repository"), "id").where("repository is not null")
    return dedup.first_per_key(rows, ["repository"], [F.asc("id")], 3)


_SLUG = f", s AS (SELECT id, split_part(name, '-', 1) AS name, {_REPO} AS full_name, quality_score FROM cur WHERE repo_full_name IS NOT NULL), o AS (SELECT id, name, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS repo, quality_score FROM s), g AS (SELECT *, concat_ws('/', owner, name) AS short, count(*) OVER (PARTITION BY concat_ws('/', owner, name)) AS n, row_number() OVER (PARTITION BY concat_ws('/', owner, name) ORDER BY quality_score DESC NULLS LAST, length(repo), repo, id) AS place FROM o), slugs AS (SELECT id, short, CASE WHEN n > 1 THEN concat_ws('/', owner, concat_ws('-', repo, name)) ELSE short END AS slug, n > 1 AND place = 1 AS winner FROM g)"


def _slugs(spark, d) -> DataFrame:
    rows = current_skills(spark, d, "name", "repo_full_name", "quality_score").where("repo_full_name is not null").withColumn("full", repo())
    # The first word of a name is shared by many records of an owner, so that slugs collide.
    rows = rows.withColumn("name", F.element_at(F.split("name", "-"), 1)).withColumn("owner", F.element_at(F.split("full", "/"), 1)).withColumn("repo", F.coalesce(F.try_element_at(F.split("full", "/"), F.lit(2)), F.lit("")))
    return ranking.slugs(rows, F.col("owner"), "name", "repo", "quality_score", "id")


@query(WITH + _SLUG + " SELECT id, slug, winner FROM slugs")
def slug_assign(spark, d) -> DataFrame:
    return _slugs(spark, d).select("id", "slug", "winner")


@query(WITH + _SLUG + " SELECT short AS old_slug, slug AS new_slug, id FROM slugs WHERE winner")
def slug_redirects(spark, d) -> DataFrame:
    return _slugs(spark, d).where("winner").select(F.col("short").alias("old_slug"), F.col("slug").alias("new_slug"), "id")


@query(WITH + f" SELECT entity_type, count(*) AS n, count(*) FILTER (coalesce(is_duplicate, false)) AS duplicates, count(*) FILTER (lower(trim(quality_tier)) = 'featured') AS featured, count(*) FILTER (coalesce(repo_archived, false)) AS archived, count(*) FILTER (try_cast(skill_first_commit_at AS TIMESTAMPTZ) >= {TS} - INTERVAL 90 DAY) AS new_90d, count(*) FILTER (try_cast(repo_pushed_at AS TIMESTAMPTZ) >= {TS} - INTERVAL 90 DAY) AS active, count(DISTINCT split_part({_REPO}, '/', 1)) AS creators, grouping(entity_type) AS total FROM cur GROUP BY ROLLUP (entity_type)")
def composition_snapshot(spark, d) -> DataFrame:
    r = current_skills(spark, d, "entity_type", "is_duplicate", "quality_tier", "repo_archived", "skill_first_commit_at", "repo_pushed_at", "repo_full_name")
    since = lambda c: F.col(c).try_cast("timestamp") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 90 days")
    r = r.withColumn("creator", F.element_at(F.split(repo(), "/"), 1))
    return r.rollup("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicates"), F.count_if(F.lower(F.trim("quality_tier")) == "featured").alias("featured"),
        F.count_if(F.coalesce("repo_archived", F.lit(False))).alias("archived"), F.count_if(since("skill_first_commit_at")).alias("new_90d"), F.count_if(since("repo_pushed_at")).alias("active"),
        F.count_distinct("creator").alias("creators"), F.grouping("entity_type").cast("long").alias("total"),
    )


_CREATOR = WITH + f""", r AS (SELECT split_part({_REPO}, '/', 1) AS creator, {_REPO} AS repository, * FROM cur WHERE repo_full_name IS NOT NULL),
  st AS (SELECT creator, sum(stars)::BIGINT AS stars, count(*) AS repositories FROM (SELECT creator, repository, max(coalesce(repo_stars, 0)) AS stars FROM r GROUP BY 1, 2) GROUP BY 1),
  a AS (SELECT creator, count(*) AS skills, count(*) FILTER (lower(trim(quality_tier)) = 'featured') AS featured, list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))) AS categories, min(skill_first_commit_at) AS first_commit, round(avg(quality_score), 4) AS mean_score FROM r GROUP BY 1),
  creators AS (SELECT * FROM a JOIN st USING (creator))"""


def _creators(spark, d) -> DataFrame:
    r = current_skills(spark, d, "repo_full_name", "repo_stars", "quality_tier", "category", "skill_first_commit_at", "quality_score").where("repo_full_name is not null").withColumn("repository", repo())
    r = r.withColumn("creator", F.element_at(F.split("repository", "/"), 1))
    # Stars count once for each repository, not for each of its records.
    per_repo = r.groupBy("creator", "repository").agg(F.max(F.coalesce("repo_stars", F.lit(0))).alias("stars"))
    stars = per_repo.groupBy("creator").agg(F.sum("stars").alias("stars"), F.count(F.lit(1)).alias("repositories"))
    own = r.groupBy("creator").agg(
        F.count(F.lit(1)).alias("skills"), F.count_if(F.lower(F.trim("quality_tier")) == "featured").alias("featured"), F.array_sort(F.collect_set("category")).alias("categories"),
        F.min("skill_first_commit_at").alias("first_commit"), F.round(F.avg("quality_score"), 4).alias("mean_score"),
    )
    return own.join(stars, "creator")


@query(_CREATOR + " SELECT creator, skills, featured, categories, first_commit, mean_score, stars, repositories FROM creators")
def creator_rollup(spark, d) -> DataFrame:
    return _creators(spark, d)


@query(_CREATOR + " SELECT board, place, creator FROM (SELECT 'skills' AS board, row_number() OVER (ORDER BY skills DESC, stars DESC, creator) AS place, creator FROM creators UNION ALL SELECT 'stars', row_number() OVER (ORDER BY stars DESC, skills DESC, creator), creator FROM creators UNION ALL SELECT 'featured', row_number() OVER (ORDER BY featured DESC, skills DESC, creator), creator FROM creators UNION ALL SELECT 'earliest', row_number() OVER (ORDER BY first_commit NULLS LAST, creator), creator FROM creators) WHERE place <= 10")
def creator_leaders(spark, d) -> DataFrame:
    from ..runtime import written

    c = written(_creators(spark, d), "creators")
    boards = {"skills": [F.desc("skills"), F.desc("stars")], "stars": [F.desc("stars"), F.desc("skills")], "featured": [F.desc("featured"), F.desc("skills")], "earliest": [F.asc_nulls_last("first_commit")]}
    out = None
    for name, order in boards.items():
        # The ten best are taken first; only they are numbered.
        top = c.orderBy(*order, "creator").limit(10)
        top = top.select(F.lit(name).alias("board"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "creator")).cast("long").alias("place"), "creator")
        out = top if out is None else out.unionByName(top)
    return out


_VALID_TAGS = r"list_sort(list_distinct(list_filter(coalesce(tags, []), lambda t: regexp_matches(t, '^([a-z][a-z_]{0,31}):([a-z0-9][a-z0-9-]{0,63})$'))))"


@query(WITH + f" SELECT tag, count(*) AS n, count(DISTINCT entity_type) AS types FROM (SELECT unnest({_VALID_TAGS}) AS tag, entity_type FROM cur) GROUP BY 1")
def tag_counts(spark, d) -> DataFrame:
    r = current_skills(spark, d, "tags", "entity_type").select(F.explode(text.valid_tags(F.col("tags"))).alias("tag"), "entity_type")
    return r.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_type").alias("types"))


@query(WITH + f" SELECT id, list_sort(list_distinct(list_concat({_VALID_TAGS}, CASE WHEN category IS NOT NULL THEN ['category:' || regexp_replace(regexp_replace(lower(replace(category, '&', 'and')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')] ELSE [] END))) AS tags FROM cur")
def merged_tags(spark, d) -> DataFrame:
    derived = F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit("category:"), text.category_slug(F.col("category"))))).otherwise(F.array().cast("array<string>"))
    return current_skills(spark, d, "tags", "category").select("id", F.array_sort(F.array_union(text.valid_tags(F.col("tags")), derived)).alias("tags"))


@query(WITH + " SELECT CASE WHEN regexp_matches(upper(left(name, 1)), '[A-Z]') THEN upper(left(name, 1)) ELSE '#' END AS section, count(*) AS n FROM cur WHERE name IS NOT NULL GROUP BY 1")
def alphabet_sections(spark, d) -> DataFrame:
    first = F.upper(F.substring("name", 1, 1))
    return current_skills(spark, d, "name").where("name is not null").groupBy(F.when(first.rlike("[A-Z]"), first).otherwise("#").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + ", top AS (SELECT category, id, quality_score FROM cur WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY quality_score DESC NULLS LAST, id) <= 5) SELECT c.id, t.id AS related, row_number() OVER (PARTITION BY c.id ORDER BY t.quality_score DESC NULLS LAST, t.id) AS place FROM cur c JOIN top t ON c.category = t.category AND c.id <> t.id QUALIFY place <= 4")
def related_items(spark, d) -> DataFrame:
    r = current_skills(spark, d, "category", "quality_score").where("category is not null")
    # Four others of a category are among its first five, so that no record meets its whole category.
    top = dedup.first_per_key(r, ["category"], [F.desc_nulls_last("quality_score"), F.asc("id")], 5).select("category", F.col("id").alias("related"), F.col("quality_score").alias("s"))
    lists = top.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(-F.coalesce("s", F.lit(-1)), "related"))).alias("top"))
    rows = r.join(lists, "category").select("id", F.posexplode(F.slice(F.filter("top", lambda x: x.related != F.col("id")), 1, 4)).alias("p", "t"))
    return rows.select("id", F.col("t.related").alias("related"), (F.col("p") + 1).cast("long").alias("place"))


@query(WITH + " SELECT id, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, repo_stars DESC NULLS LAST, repo_pushed_at DESC NULLS LAST, id) AS place, place <= 12 AS visible FROM cur QUALIFY place <= 100")
def catalog_top(spark, d) -> DataFrame:
    order = [F.desc_nulls_last("quality_score"), F.desc_nulls_last("repo_stars"), F.desc_nulls_last("repo_pushed_at"), F.asc("id")]
    top = current_skills(spark, d, "quality_score", "repo_stars", "repo_pushed_at").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")).select("id", "place", (F.col("place") <= 12).alias("visible"))


@query(WITH + f", e AS (SELECT id, entity_type, coalesce(try_cast(skill_first_commit_at AS TIMESTAMPTZ), scraped_at) AS seen_at FROM cur WHERE NOT coalesce(is_duplicate, false)), w AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY seen_at DESC, id) AS p FROM e WHERE seen_at >= {TS} - INTERVAL 60 DAY AND seen_at <= {TS}) SELECT id, entity_type, seen_at FROM w WHERE entity_type <> 'plugin' OR p <= 10 ORDER BY seen_at DESC, id LIMIT 100")
def whats_new(spark, d) -> DataFrame:
    r = current_skills(spark, d, "entity_type", "skill_first_commit_at", "is_duplicate").where(~F.coalesce("is_duplicate", F.lit(False)))
    r = r.select("id", "entity_type", F.coalesce(F.col("skill_first_commit_at").try_cast("timestamp"), "scraped_at").alias("seen_at"))
    now = F.lit(AS_OF).cast("timestamp")
    r = r.where((F.col("seen_at") >= now - F.expr("interval 60 days")) & (F.col("seen_at") <= now) & F.col("entity_type").isNotNull())
    return dedup.cap_for_type(r, "entity_type", "plugin", 10, [F.desc("seen_at"), F.asc("id")]).orderBy(F.desc("seen_at"), "id").limit(100)


@query(WITH + f", e AS (SELECT id, quality_score, novelty_score, lower(trim(quality_tier)) AS tier, scraped_at AS seen_at FROM cur WHERE NOT coalesce(is_duplicate, false)) SELECT id, round(coalesce(quality_score, 0) + 100 * coalesce(novelty_score, 0), 6) AS weight FROM e WHERE seen_at >= {TS} - INTERVAL 14 DAY AND (tier = 'featured' OR novelty_score > 0.5) ORDER BY weight DESC, id LIMIT 25")
def notable(spark, d) -> DataFrame:
    r = current_skills(spark, d, "quality_score", "novelty_score", "quality_tier", "is_duplicate").where(~F.coalesce("is_duplicate", F.lit(False)))
    r = r.where((F.col("scraped_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 14 days")) & ((F.lower(F.trim("quality_tier")) == "featured") | (F.col("novelty_score") > 0.5)))
    return r.select("id", F.round(scoring.trending_weight(F.col("quality_score"), F.col("novelty_score")), 6).alias("weight")).orderBy(F.desc("weight"), "id").limit(25)


_GROWTH = "WITH pulse AS (SELECT repo_full_name, date_trunc('month', snapshot_date)::DATE AS snapshot_date, s FROM repo_pulse), last AS (SELECT max(snapshot_date) AS l FROM pulse), base AS (SELECT coalesce(max(snapshot_date) FILTER (snapshot_date <= l - 28), min(snapshot_date) FILTER (snapshot_date < l)) AS b FROM pulse, last), a AS (SELECT repo_full_name, max(CASE WHEN snapshot_date = l THEN s END) AS now, max(CASE WHEN snapshot_date = b THEN s END) AS before FROM pulse, last, base WHERE snapshot_date IN (l, b) AND repo_full_name IS NOT NULL GROUP BY 1) SELECT repo_full_name, now, before, now - before AS delta FROM a WHERE now IS NOT NULL AND before IS NOT NULL"


@query(_GROWTH)
def star_growth(spark, d) -> DataFrame:
    pulse = table(spark, d, "repo_pulse").select("repo_full_name", F.trunc("snapshot_date", "month").alias("month"), "s")
    return links.growth(pulse, "month", "repo_full_name", "s", 28)


@query("WITH g AS (" + _GROWTH + ") SELECT repo_full_name, delta FROM g WHERE delta > 0 ORDER BY delta DESC, repo_full_name LIMIT 50")
def trending(spark, d) -> DataFrame:
    return star_growth(spark, d).where("delta > 0").select("repo_full_name", "delta").orderBy(F.desc("delta"), "repo_full_name").limit(50)


@query(WITH + f", p AS (SELECT (epoch({TS}) - epoch(try_cast(repo_pushed_at AS TIMESTAMPTZ))) / 86400.0 AS days FROM cur) SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 7 THEN '7d' WHEN days <= 30 THEN '30d' WHEN days <= 90 THEN '90d' WHEN days <= 180 THEN '180d' ELSE 'older' END AS bucket, count(*) AS n FROM p GROUP BY 1")
def maintenance_buckets(spark, d) -> DataFrame:
    days = scoring.days_before(F.col("repo_pushed_at"), AS_OF)
    bucket = F.when(days.isNull(), "unknown").when(days <= 7, "7d").when(days <= 30, "30d").when(days <= 90, "90d").when(days <= 180, "180d").otherwise("older")
    return current_skills(spark, d, "repo_pushed_at").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + f", weeks AS (SELECT unnest(range(date_trunc('week', DATE '{AS_OF[:10]}')::TIMESTAMP - INTERVAL 357 DAY, date_trunc('week', DATE '{AS_OF[:10]}')::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS week), c AS (SELECT date_trunc('week', try_cast(skill_first_commit_at AS TIMESTAMPTZ))::DATE AS week, count(*) AS n FROM cur GROUP BY 1) SELECT week::VARCHAR AS week, coalesce(n, 0) AS n FROM weeks LEFT JOIN c USING (week)")
def weekly_buckets(spark, d) -> DataFrame:
    this = f"cast(date_trunc('week', date'{AS_OF[:10]}') as date)"
    weeks = spark.range(1).select(F.explode(F.expr(f"sequence({this} - interval 357 days, {this}, interval 7 days)")).alias("week"))
    n = current_skills(spark, d, "skill_first_commit_at").groupBy(F.date_trunc("week", F.col("skill_first_commit_at").try_cast("timestamp")).cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.join(n, "week", "left").select(F.col("week").cast("string").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


_SERIES = "WITH r AS (SELECT repo_full_name, snapshot_date, max(s) AS s FROM repo_pulse WHERE repo_full_name IS NOT NULL GROUP BY 1, 2)"


@query(_SERIES + ", n AS (SELECT *, row_number() OVER (PARTITION BY repo_full_name ORDER BY snapshot_date) - 1 AS i, count(*) OVER (PARTITION BY repo_full_name) AS n FROM r) SELECT repo_full_name, snapshot_date::VARCHAR AS snapshot_date, s FROM n WHERE n <= 4 OR i = n - 1 OR i IN (SELECT unnest([floor(0 * (n / 4.0::DOUBLE)), floor(1 * (n / 4.0::DOUBLE)), floor(2 * (n / 4.0::DOUBLE)), floor(3 * (n / 4.0::DOUBLE))])::BIGINT)")
def star_series(spark, d) -> DataFrame:
    r = table(spark, d, "repo_pulse").where("repo_full_name is not null").groupBy("repo_full_name", "snapshot_date").agg(F.max("s").alias("s"))
    return ranking.downsample(r, ["repo_full_name"], [F.asc("snapshot_date")], 4).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query(_SERIES + " SELECT repo_full_name, snapshot_date::VARCHAR AS snapshot_date, count(*) OVER (PARTITION BY repo_full_name ORDER BY snapshot_date) AS snapshots, sum(coalesce(s, 0)) OVER (PARTITION BY repo_full_name ORDER BY snapshot_date)::BIGINT AS running FROM r")
def cumulative_counts(spark, d) -> DataFrame:
    r = table(spark, d, "repo_pulse").where("repo_full_name is not null").groupBy("repo_full_name", "snapshot_date").agg(F.max("s").alias("s"))
    w = Window.partitionBy("repo_full_name").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("repo_full_name", F.col("snapshot_date").cast("string").alias("snapshot_date"), F.count(F.lit(1)).over(w).alias("snapshots"), F.sum(F.coalesce("s", F.lit(0))).over(w).alias("running"))


#: Services as the test tables know them; the operator takes any such table.
SERVICES = {"logs": ["logs", "logging"], "calendars": ["calendar"], "tickets": ["ticket"], "invoices": ["invoice"], "endpoints": ["endpoint", "port"], "mails": ["mail"], "tests": ["test"], "repos": ["repo"], "tokens": ["token", "key"], "docs": ["docs"]}


def _services_sql() -> str:
    import re

    hit = lambda p: f"regexp_matches(t, '\\b{re.escape(p)}\\b')" if len(p) <= 4 else f"contains(t, '{p}')"
    each = ", ".join(f"CASE WHEN {' OR '.join(hit(p) for p in ps)} THEN '{s}' END" for s, ps in SERVICES.items())
    return WITH + f", t AS (SELECT id, lower(concat_ws(' ', name, description)) AS t FROM cur), pairs AS (SELECT id, unnest(list_filter([{each}], lambda x: x IS NOT NULL)) AS service FROM t)"


def _service_pairs(spark, d) -> DataFrame:
    return links.services_of(current_skills(spark, d, "name", "description"), "id", F.concat_ws(" ", "name", "description"), SERVICES)


@query(_services_sql() + " SELECT service, count(*) AS n, list_slice(list_sort(list(id)), 1, 20) AS first_ids FROM pairs GROUP BY 1")
def service_graph(spark, d) -> DataFrame:
    p = _service_pairs(spark, d)
    first = dedup.first_per_key(p, ["service"], [F.asc("id")], 20).groupBy("service").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    return p.groupBy("service").agg(F.count(F.lit(1)).alias("n")).join(first, "service")


@query(_services_sql() + " SELECT a.service, b.service AS other, count(*) AS together, row_number() OVER (PARTITION BY a.service ORDER BY count(*) DESC, b.service) AS place FROM pairs a JOIN pairs b ON a.id = b.id AND a.service <> b.service GROUP BY 1, 2 QUALIFY place <= 8")
def co_occurrence(spark, d) -> DataFrame:
    return links.co_occurrences(_service_pairs(spark, d))


_PATH = r"regexp_replace(regexp_replace(regexp_replace(id, '^[a-z_]+:[^/]+/[^/]+/?', ''), '/?SKILL\.md$', ''), '/[^/]*$', '')"


@query(
    WITH + r", r AS (SELECT id, entity_type, regexp_extract(id, '^[a-z_]+:([^/]+/[^/]+)', 1) AS repo, regexp_replace(regexp_replace(id, '^[a-z_]+:[^/]+/[^/]+/?', ''), '/?SKILL\.md$', '') AS path FROM cur), "
    "p AS (SELECT id AS parent, repo, regexp_replace(path, '/?[^/]*$', '') AS dir FROM r WHERE entity_type = 'plugin') "
    "SELECT DISTINCT parent, r.id AS child FROM p JOIN r ON p.repo = r.repo AND r.entity_type <> 'plugin' AND (p.dir = '' OR r.path = p.dir OR starts_with(r.path, p.dir || '/'))"
)
def bundle_links(spark, d) -> DataFrame:
    r = current_skills(spark, d, "entity_type").select("id", "entity_type", F.regexp_extract("id", "^[a-z_]+:([^/]+/[^/]+)", 1).alias("repo"), F.regexp_replace(F.regexp_replace("id", "^[a-z_]+:[^/]+/[^/]+/?", ""), r"/?SKILL\.md$", "").alias("path"))
    parents = r.where("entity_type = 'plugin'").select("id", "repo", F.regexp_replace("path", "/?[^/]*$", "").alias("path"))
    return links.contained(parents, r.where("entity_type <> 'plugin'"), "repo", "path", "id")


_OLD = "old AS (SELECT * FROM skills WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at, row_id) = 1)"


def _oldest(spark, d, *columns) -> DataFrame:
    need = list(dict.fromkeys(["id", *columns, "scraped_at", "row_id"]))
    return dedup.first_per_key(table(spark, d, "skills").select(*need).where("id is not null"), ["id"], [F.asc("scraped_at"), F.asc("row_id")])


@query(WITH + ", " + _OLD + " SELECT o.id, coalesce(c.repo_stars, o.repo_stars) AS repo_stars, coalesce(c.quality_score, o.quality_score) AS quality_score, coalesce(c.repo_license, o.repo_license) AS repo_license FROM old o LEFT JOIN cur c USING (id)")
def freshness_merge(spark, d) -> DataFrame:
    cols = ["repo_stars", "quality_score", "repo_license"]
    return dedup.fill_from(_oldest(spark, d, *cols).select("id", *cols), current_skills(spark, d, *cols), "id", cols, prefer_prior=True)


@query(WITH + ", " + _OLD + " SELECT c.id, coalesce(c.novelty_score, o.novelty_score) AS novelty_score, coalesce(c.canonical_slug, o.canonical_slug) AS canonical_slug FROM cur c LEFT JOIN old o USING (id)")
def preserve_enrichments(spark, d) -> DataFrame:
    cols = ["novelty_score", "canonical_slug"]
    return dedup.fill_from(current_skills(spark, d, *cols).select("id", *cols), _oldest(spark, d, *cols), "id", cols, prefer_prior=False)


@query(WITH + ", " + _OLD + " SELECT c.id, CASE WHEN c.content_sha = o.content_sha THEN 'unchanged' ELSE 'changed' END AS state FROM cur c JOIN old o USING (id) WHERE c.scraped_at >= TIMESTAMPTZ '2026-01-05 00:00:00+00' AND o.scraped_at < TIMESTAMPTZ '2026-01-05 00:00:00+00' UNION ALL SELECT c.id, 'added' FROM cur c JOIN old o USING (id) WHERE c.scraped_at >= TIMESTAMPTZ '2026-01-05 00:00:00+00' AND o.scraped_at >= TIMESTAMPTZ '2026-01-05 00:00:00+00'")
def delta_states(spark, d) -> DataFrame:
    cut = F.lit("2026-01-05").cast("timestamp")
    new = current_skills(spark, d, "content_sha").where(F.col("scraped_at") >= cut)
    old = _oldest(spark, d, "content_sha").where(F.col("scraped_at") < cut)
    return dedup.changed_rows(new, old, "id", "content_sha").select("id", "state")


@query(WITH + " SELECT id, CASE WHEN length(description) > 40 THEN left(description, 40) || '...' ELSE description END AS short, abs(coalesce(body_length, 0) - coalesce(length(body_markdown), 0)) > 10 AND NOT coalesce(ends_with(body_markdown, '...'), false) AS repaired, left(regexp_replace(regexp_replace(lower(trim(name)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), 64) AS clean_name, left(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1024) AS clean_description FROM cur")
def trimmed_texts(spark, d) -> DataFrame:
    r = current_skills(spark, d, "name", "description", "body_length", "body_markdown")
    off = (F.abs(F.coalesce("body_length", F.lit(0)) - F.coalesce(F.length("body_markdown"), F.lit(0))) > 10) & ~F.coalesce(F.endswith("body_markdown", F.lit("...")), F.lit(False))
    return r.select("id", text.truncated(F.col("description"), 40).alias("short"), off.alias("repaired"), text.clean_name(F.col("name")).alias("clean_name"), text.clean_description(F.col("description")).alias("clean_description"))


@query(WITH + " SELECT id, left(concat_ws(chr(10), nullif(name, ''), nullif(description, ''), nullif(left(body_markdown, 200), '')), 6000) AS input, sha256(concat_ws(chr(10), nullif(name, ''), nullif(description, ''), nullif(left(body_markdown, 200), ''))) AS sha, CASE WHEN length(id) <= 64 THEN regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g') ELSE 'sk_' || left(sha256(id), 40) END AS vector_id FROM cur")
def embedding_inputs(spark, d) -> DataFrame:
    some = lambda c: F.nullif(c, F.lit(""))
    joined = F.concat_ws("\n", some(F.col("name")), some(F.col("description")), some(F.substring("body_markdown", 1, 200)))
    return current_skills(spark, d, "name", "description", "body_markdown").select("id", F.substring(joined, 1, 6000).alias("input"), F.sha2(joined, 256).alias("sha"), text.vector_id(F.col("id")).alias("vector_id"))


@query(WITH + " SELECT id, left(concat_ws(chr(10) || chr(10), nullif(name, ''), nullif(description, ''), nullif(category, ''), nullif(left(body_markdown, 1500), '')), 6000) AS input, sha256(coalesce(name, '') || '|' || coalesce(description, '') || '|' || coalesce(category, '') || '|' || coalesce(body_markdown, '')) AS sha, CASE WHEN length(id) <= 64 THEN regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g') ELSE 'sk_' || left(sha256(id), 40) END AS vector_id FROM cur")
def embedding_records(spark, d) -> DataFrame:
    """What is embedded of each record, by the skill builder, and the sha that tells whether it must be embedded again.

    The sha is over the whole body, not over the part that is embedded, so a change anywhere is seen. ``embedding_inputs`` has the
    first 200 characters of the body only.
    """
    from ..functions.entities import EMBEDDING_INPUTS

    fields = ("name", "description", "category", "body_markdown")
    whole = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    return current_skills(spark, d, *fields).select("id", EMBEDDING_INPUTS["skill"](*map(F.col, fields)).alias("input"), F.sha2(whole, 256).alias("sha"), text.vector_id(F.col("id")).alias("vector_id"))


@query(WITH + " SELECT count(*) AS records, count(*) FILTER (NOT coalesce(is_duplicate, false)) AS visible, count(*) FILTER (array_has(coalesce(tags, []), 'category:operations') AND NOT coalesce(is_duplicate, false)) AS operations, count(*) FILTER (entity_type = 'plugin' AND quality_score >= 50) AS good_plugins FROM cur")
def filtered_counts(spark, d) -> DataFrame:
    r = current_skills(spark, d, "is_duplicate", "tags", "entity_type", "quality_score")
    seen = ~F.coalesce("is_duplicate", F.lit(False))
    return r.agg(F.count(F.lit(1)).alias("records"), F.count_if(seen).alias("visible"), F.count_if(F.coalesce(F.array_contains("tags", "category:operations"), F.lit(False)) & seen).alias("operations"), F.count_if((F.col("entity_type") == "plugin") & (F.col("quality_score") >= 50)).alias("good_plugins"))


@query(WITH + ", e AS (SELECT unnest([{'rule': 'raw_not_empty', 'broken': (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM skills)}, {'rule': 'id_unique', 'broken': (SELECT count(*) - count(DISTINCT id) FROM cur)}, {'rule': 'score_in_range', 'broken': (SELECT count(*) FROM cur WHERE quality_score NOT BETWEEN 0 AND 100)}, {'rule': 'tier_known', 'broken': (SELECT count(*) FROM cur WHERE quality_tier NOT IN ('featured', 'solid', 'listed'))}, {'rule': 'collapse', 'broken': (SELECT CASE WHEN (SELECT count(*) FROM cur) < 0.5 * (SELECT count(DISTINCT id) FROM skills) THEN 1 ELSE 0 END)}]) AS r) SELECT r.rule AS rule, r.broken::BIGINT AS broken FROM e")
def expectations(spark, d) -> DataFrame:
    from ..operators.reports import expectations as check

    cur = current_skills(spark, d, "quality_score", "quality_tier")
    raw = table(spark, d, "skills")
    known = {"raw": raw.agg(F.count(F.lit(1))).scalar(), "ids": raw.agg(F.count_distinct("id")).scalar()}
    own = cur.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(~F.col("quality_score").between(0, 100)).alias("range"), F.count_if(~F.col("quality_tier").isin("featured", "solid", "listed")).alias("tier"))
    both = own.withColumns(known)
    return check(both, {"raw_not_empty": (F.col("raw") == 0).cast("long"), "id_unique": F.col("n") - F.col("distinct"), "score_in_range": F.col("range"), "tier_known": F.col("tier"), "collapse": (F.col("n") < 0.5 * F.col("ids")).cast("long")})


@query(WITH + ", a AS (SELECT id, quality_score FROM cur WHERE source = 'seed'), b AS (SELECT id, quality_score FROM cur WHERE source IN ('seed', 'topics')) SELECT 'only_b' AS part, count(*) AS n FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'both', count(*) FROM b WHERE id IN (SELECT id FROM a) UNION ALL SELECT 'union', count(DISTINCT id) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")
def set_operations(spark, d) -> DataFrame:
    r = current_skills(spark, d, "source")
    a, b = r.where("source = 'seed'").select("id"), r.where("source in ('seed', 'topics')").select("id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(b.join(a, "id", "left_anti"), "only_b").union(count(b.intersect(a), "both")).union(count(a.union(b).distinct(), "union"))


@query("WITH c AS (SELECT *, CASE source WHEN 'code-search' THEN 1 WHEN 'topics' THEN 2 WHEN 'seed' THEN 3 ELSE 4 END AS p FROM skills WHERE slug IS NOT NULL) SELECT slug, arg_max(source, -p) AS source FROM c GROUP BY 1")
def union_precedence(spark, d) -> DataFrame:
    r = table(spark, d, "skills").select("slug", "source")
    parts = [r.where(F.col("source") == s) for s in ("code-search", "topics", "seed")] + [r.where(~F.coalesce(F.col("source").isin("code-search", "topics", "seed"), F.lit(False)))]
    return dedup.union_by_precedence(parts, ["slug"])


@query(WITH + " SELECT to_json({'id': id, 'url': '/skills/' || slug, 'title': name, 'summary': CASE WHEN length(description) > 30 THEN left(description, 30) || '…' ELSE description END})::VARCHAR AS item, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, id) AS place FROM cur WHERE lower(trim(quality_tier)) IN ('featured', 'solid') QUALIFY place <= 50")
def feed_items(spark, d) -> DataFrame:
    r = current_skills(spark, d, "slug", "name", "description", "quality_score", "quality_tier").where(F.lower(F.trim("quality_tier")).isin("featured", "solid"))
    top = r.orderBy(F.desc_nulls_last("quality_score"), "id").limit(50)
    item = F.struct("id", F.concat(F.lit("/skills/"), "slug").alias("url"), F.col("name").alias("title"), text.truncated(F.col("description"), 30, "…").alias("summary"))
    return top.select(F.to_json(item, {"ignoreNullFields": "false"}).alias("item"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("quality_score"), "id")).cast("long").alias("place"))
