"""Queries over single operators that the larger ones do not show: per-type scores, lookups, labels, drift, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import access, scoring, text
from ..operators import reports
from .common import AS_OF, CURRENT_SQL, LISTED_SQL, current_apis, current_skills, table

QUERIES, ORACLES = {}, {}
WITH = f"WITH {CURRENT_SQL}, {LISTED_SQL}"
TS = f"TIMESTAMPTZ '{AS_OF}+00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_TYPED = "CASE WHEN length(trim(coalesce(description, ''))) >= 50 THEN 1 ELSE 0 END + CASE WHEN repo_license IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(tags) >= 1 THEN 1 ELSE 0 END"


@query(WITH + f" SELECT id, entity_type, round(CASE entity_type WHEN 'plugin' THEN ({_TYPED} + CASE WHEN category IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN schema_version >= 2 THEN 1 ELSE 0 END) / 5.0::DOUBLE WHEN 'mcp_server' THEN ({_TYPED}) / 3.0::DOUBLE ELSE 0 END, 6)::DOUBLE AS manifest FROM cur")
def manifest_completeness(spark, d) -> DataFrame:
    r = current_skills(spark, d, "entity_type", "description", "repo_license", "tags", "category", "schema_version")
    three = [F.length(F.trim(F.coalesce("description", F.lit("")))) >= 50, F.col("repo_license").isNotNull(), F.size("tags") >= 1]
    share = F.when(F.col("entity_type") == "plugin", scoring.manifest_share(*three, F.col("category").isNotNull(), F.col("schema_version") >= 2)).when(F.col("entity_type") == "mcp_server", scoring.manifest_share(*three)).otherwise(0.0)
    return r.select("id", "entity_type", F.round(share, 6).alias("manifest"))


_DAYS = f"(epoch({TS}) - epoch(try_cast(extra.source_modified_at AS TIMESTAMPTZ))) / 86400.0"


@query(WITH + f" SELECT id, CASE WHEN {_DAYS} IS NULL THEN 0 WHEN {_DAYS} <= 30 THEN 100 WHEN {_DAYS} <= 90 THEN 90 WHEN {_DAYS} <= 180 THEN 75 WHEN {_DAYS} <= 365 THEN 50 WHEN {_DAYS} <= 730 THEN 25 ELSE 5 END AS freshness, CASE WHEN {_DAYS} IS NULL THEN 'unknown' WHEN {_DAYS} < 1 THEN 'today' WHEN {_DAYS} < 30 THEN floor({_DAYS})::BIGINT || 'd' WHEN {_DAYS} < 365 THEN floor({_DAYS} / 30)::BIGINT || 'mo' ELSE floor({_DAYS} / 365)::BIGINT || 'y' END AS age FROM listed")
def dataset_freshness(spark, d) -> DataFrame:
    r = current_apis(spark, d, "extra")
    at = F.col("extra.source_modified_at")
    return r.select("id", scoring.dataset_freshness(at, AS_OF).alias("freshness"), access.ago(scoring.days_before(at, AS_OF)).alias("age"))


@query(WITH + " SELECT id, CASE access.cost.model WHEN 'free' THEN 'Free' WHEN 'freemium' THEN 'Free tier' WHEN 'paid' THEN 'Paid' ELSE 'Unknown' END AS cost, CASE WHEN extra.endpoint_count IS NOT NULL THEN extra.endpoint_count || ' per day' ELSE 'Unknown' END AS limits, CASE WHEN length(description) IS NULL THEN '-' WHEN length(description) < 1024 THEN length(description) || ' B' END AS size FROM listed")
def access_labels(spark, d) -> DataFrame:
    r = current_apis(spark, d, "access", "extra", "description")
    n = F.col("extra.endpoint_count")
    return r.select("id", access.cost_label(F.col("access.cost.model")).alias("cost"), access.limit_label(n, F.when(n.isNotNull(), F.lit("day"))).alias("limits"), access.bytes_label(F.length("description")).alias("size"))


@query(WITH + " SELECT id, CASE WHEN extra.spec_version IS NOT NULL AND access.auth.type IS NOT NULL THEN 'spec_auth' WHEN access.auth.type IS NOT NULL THEN 'list_auth' END AS method, CASE WHEN extra.spec_version IS NOT NULL AND access.auth.type IS NOT NULL THEN 0.9 WHEN access.auth.type IS NOT NULL THEN 0.6 END::DOUBLE AS confidence FROM listed")
def access_ladder(spark, d) -> DataFrame:
    r = current_apis(spark, d, "access", "extra")
    auth = F.col("access.auth.type")
    pick = access.best(access.found(auth, "list_auth"), access.found(F.when(F.col("extra.spec_version").isNotNull(), auth), "spec_auth"))
    return r.select("id", pick.alias("f")).select("id", "f.method", "f.confidence")


@query(WITH + " SELECT v.id, c.slug, c.quality_score FROM (SELECT DISTINCT id, metadata.skill_id AS skill_id FROM skill_vectors) v LEFT JOIN cur c ON v.skill_id = c.id")
def vector_lookup(spark, d) -> DataFrame:
    v = table(spark, d, "skill_vectors").select("id", F.col("metadata.skill_id").alias("skill_id")).distinct()
    c = current_skills(spark, d, "slug", "quality_score").select(F.col("id").alias("skill_id"), "slug", "quality_score")
    return v.join(c, "skill_id", "left").select("id", "slug", "quality_score")


@query(WITH + " SELECT c.id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM skill_vectors v WHERE v.metadata.skill_id = c.id)")
def without_vector(spark, d) -> DataFrame:
    v = table(spark, d, "skill_vectors").select(F.col("metadata.skill_id").alias("id"))
    return current_skills(spark, d).select("id").join(v, "id", "left_anti")


@query(WITH + " SELECT c.n AS records, m.n AS matched, m.n < 0.5 * c.n AND c.n >= 50 AS drifted FROM (SELECT count(*) AS n FROM cur) c, (SELECT count(*) AS n FROM cur WHERE id IN (SELECT metadata.skill_id FROM skill_vectors)) m")
def embedding_drift(spark, d) -> DataFrame:
    v = table(spark, d, "skill_vectors").select(F.col("metadata.skill_id").alias("id")).distinct().withColumn("m", F.lit(1))
    n = current_skills(spark, d).select("id").join(v, "id", "left").agg(F.count(F.lit(1)).alias("records"), F.count("m").alias("matched"))
    return n.withColumn("drifted", (F.col("matched") < 0.5 * F.col("records")) & (F.col("records") >= 50))


@query("WITH need AS (SELECT unnest(['category', 'entity_type', 'quality_score', 'language']) AS name), have AS (SELECT unnest(['name', 'slug', 'skill_id', 'category', 'quality_score', 'entity_type']) AS name) SELECT name FROM need WHERE name NOT IN (SELECT name FROM have)")
def index_plan(spark, d) -> DataFrame:
    have = table(spark, d, "skill_vectors").schema["metadata"].dataType.fieldNames()
    need = spark.createDataFrame([(n,) for n in ("category", "entity_type", "quality_score", "language")], "name string")
    return need.join(spark.createDataFrame([(n,) for n in have], "name string"), "name", "left_anti")


@query("SELECT event_id, left('/' || event_type || '/' || repeat('x', (event_id % 400)::INT), 256) AS path, epoch_us(ts) // 1000 AS at_ms, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events")
def log_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    path = F.concat(F.lit("/"), "event_type", F.lit("/"), F.expr("repeat('x', cast(event_id % 400 as int))"))
    return e.select("event_id", F.substring(path, 1, 256).alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'missing' WHEN value < 5 THEN 'low' WHEN value > 95 THEN 'high' END AS invalid, round(greatest(5, least(95, value)), 4)::DOUBLE AS clamped FROM events")
def clamped_values(spark, d) -> DataFrame:
    v = F.col("value")
    reason = F.when(v.isNull(), "missing").when(v < 5, "low").when(v > 95, "high")
    return table(spark, d, "events").select("event_id", reason.alias("invalid"), F.round(F.greatest(F.lit(5.0), F.least(F.lit(95.0), v)), 4).alias("clamped"))


@query(WITH + " SELECT entity_type, category, n FROM (SELECT entity_type, category, count(*) AS n FROM cur WHERE category IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, category) = 1")
def main_category(spark, d) -> DataFrame:
    n = current_skills(spark, d, "entity_type", "category").where("category is not null").groupBy("entity_type", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity_type").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("t")).select("entity_type", F.col("t.category").alias("category"), (-F.col("t.m")).alias("n"))


@query(WITH + " SELECT entity_type, list_transform(list_sort(list({'m': -n, 'key': source})), lambda x: x.key || '=' || (-x.m)) AS sources FROM (SELECT entity_type, source, count(*) AS n FROM cur WHERE source IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def ordered_counts(spark, d) -> DataFrame:
    n = current_skills(spark, d, "entity_type", "source").where("source is not null").groupBy("entity_type", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity_type").agg(reports.counts_desc("source", "n").alias("c")).select("entity_type", F.transform("c", lambda x: F.concat_ws("=", x.key, x.n.cast("string"))).alias("sources"))


@query(WITH + " SELECT DISTINCT split_part(repo_full_name, '/', 1) AS creator FROM cur WHERE contains(lower(repo_full_name), 'ba') AND entity_type IN ('skill', 'plugin') AND list_has_any(tags, ['category:operations', 'category:api-backend'])")
def creator_filter(spark, d) -> DataFrame:
    r = current_skills(spark, d, "repo_full_name", "entity_type", "tags").where(F.contains(F.lower("repo_full_name"), F.lit("ba")) & F.col("entity_type").isin("skill", "plugin") & F.arrays_overlap("tags", F.array(F.lit("category:operations"), F.lit("category:api-backend"))))
    return r.select(F.element_at(F.split("repo_full_name", "/"), 1).alias("creator")).distinct()


@query(WITH + " SELECT id, 'install ' || CASE entity_type WHEN 'plugin' THEN 'plugin ' || slug WHEN 'mcp_server' THEN 'server ' || name ELSE 'skill ' || slug END AS command, '/' || CASE entity_type WHEN 'plugin' THEN 'plugins' WHEN 'mcp_server' THEN 'servers' ELSE 'skills' END || '/' || slug AS path FROM cur")
def detail_paths(spark, d) -> DataFrame:
    t = F.col("entity_type")
    what = F.when(t == "plugin", F.concat(F.lit("plugin "), "slug")).when(t == "mcp_server", F.concat(F.lit("server "), "name")).otherwise(F.concat(F.lit("skill "), "slug"))
    folder = F.when(t == "plugin", "plugins").when(t == "mcp_server", "servers").otherwise("skills")
    return current_skills(spark, d, "entity_type", "slug", "name").select("id", F.concat(F.lit("install "), what).alias("command"), F.concat(F.lit("/"), folder, F.lit("/"), "slug").alias("path"))


@query(WITH + " SELECT count(*) FILTER (repo_archived) AS archived, count(*) FILTER (repo_stars > 10) AS starred, round(avg(repo_stars), 4)::DOUBLE AS mean_stars, sum(repo_forks)::BIGINT AS forks, count(*) FILTER (repo_license IS NULL) AS unlicensed, count(DISTINCT repo_full_name) AS repositories FROM cur WHERE entity_type = 'plugin'")
def plugin_meta(spark, d) -> DataFrame:
    r = current_skills(spark, d, "entity_type", "repo_archived", "repo_stars", "repo_forks", "repo_license", "repo_full_name").where("entity_type = 'plugin'")
    return r.agg(F.count_if("repo_archived").alias("archived"), F.count_if(F.col("repo_stars") > 10).alias("starred"), F.round(F.avg("repo_stars"), 4).alias("mean_stars"), F.sum("repo_forks").alias("forks"), F.count_if(F.col("repo_license").isNull()).alias("unlicensed"), F.count_distinct("repo_full_name").alias("repositories"))


@query("SELECT id, sha256(id || '#0') AS seed, round(('0x' || left(sha256(id || '#0'), 2))::INT / 255.0 * 2 - 1, 6)::DOUBLE AS first FROM (SELECT DISTINCT id FROM skill_vectors)")
def pseudo_vectors(spark, d) -> DataFrame:
    v = table(spark, d, "skill_vectors").select("id").distinct()
    seed = F.sha2(F.concat("id", F.lit("#0")), 256)
    return v.select("id", seed.alias("seed"), F.round(F.conv(F.substring(seed, 1, 2), 16, 10).cast("int") / 255.0 * 2 - 1, 6).alias("first"))


@query("SELECT doc_id, length(text) AS n, n_chars = length(text) AS agrees, list_slice(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT array_has([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)), 1, 3) AS first_words FROM documents WHERE text IS NOT NULL")
def first_words(spark, d) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).cast("long").alias("n"), (F.col("n_chars") == F.length(t)).alias("agrees"), F.slice(text.words(t), 1, 3).alias("first_words"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT array_has([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)) AS words FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(words) AS n, sha256(array_to_string(words, ' ')) AS words_sha FROM w")
def all_words(spark, d) -> DataFrame:
    """Every word of a document, in order, as number and hash; ``first_words`` shows the first three."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.words(F.col("text")).alias("words"))
    return t.select("doc_id", F.size("words").cast("long").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("words_sha"))


_CAT = "regexp_replace(coalesce(array_to_string(tags, ', '), ''), 'category:', '', 'g')"


@query(WITH + f" SELECT id, CASE WHEN entity_type = 'skill' THEN left(concat_ws(chr(10) || chr(10), nullif(name, ''), nullif(description, ''), nullif(category, ''), nullif(left(body_markdown, 1500), '')), 6000) WHEN entity_type = 'plugin' THEN left(coalesce(name, '') || ' | ' || coalesce(description, '') || ' | ' || coalesce(array_to_string(tags, ', '), ''), 200) WHEN entity_type = 'mcp_server' THEN left(coalesce(name, '') || ' | ' || coalesce(description, '') || ' | transport=null | tools: ', 200) END AS input FROM cur")
def typed_inputs(spark, d) -> DataFrame:
    from ..functions.entities import EMBEDDING_INPUTS as inputs

    r = current_skills(spark, d, "entity_type", "name", "description", "category", "body_markdown", "tags")
    c, t = F.col, F.col("entity_type")
    text_ = F.when(t == "skill", inputs["skill"](c("name"), c("description"), c("category"), c("body_markdown"))).when(t == "plugin", inputs["plugin"](c("name"), c("description"), c("tags"))).when(t == "mcp_server", inputs["mcp_server"](c("name"), c("description"), F.lit(None).cast("string"), F.array().cast("array<string>")))
    return r.select("id", text_.alias("input"))


@query(WITH + " SELECT id, coalesce(slug, '') <> '' AND NOT contains(coalesce(slug, ''), '..') AND NOT starts_with(coalesce(slug, ''), '/') AS valid, repo_pushed_at > coalesce(skill_first_commit_at, '') OR skill_first_commit_at IS NULL AS walk FROM cur WHERE repo_pushed_at IS NOT NULL")
def record_checks(spark, d) -> DataFrame:
    from ..functions.entities import needs_walk, valid_slug

    r = current_skills(spark, d, "slug", "repo_pushed_at", "skill_first_commit_at").where("repo_pushed_at is not null")
    return r.select("id", valid_slug(F.col("slug")).alias("valid"), needs_walk(F.col("skill_first_commit_at"), F.col("repo_pushed_at")).alias("walk"))


@query(WITH + ", s AS (SELECT *, row_number() OVER (PARTITION BY split_part(repo_full_name, '/', 1), split_part(name, '-', 1) ORDER BY id) AS p FROM cur WHERE repo_full_name IS NOT NULL) SELECT e.id, r.slug AS redirected FROM s e LEFT JOIN s r ON split_part(e.repo_full_name, '/', 1) = split_part(r.repo_full_name, '/', 1) AND split_part(e.name, '-', 1) = split_part(r.name, '-', 1) AND r.p = 1")
def redirect_lookup(spark, d) -> DataFrame:
    from ..operators.dedup import first_per_key

    r = current_skills(spark, d, "slug", "name", "repo_full_name").where("repo_full_name is not null")
    r = r.select("id", "slug", F.element_at(F.split("repo_full_name", "/"), 1).alias("owner"), F.element_at(F.split("name", "-"), 1).alias("stem"))
    to = first_per_key(r, ["owner", "stem"], [F.asc("id")]).select("owner", "stem", F.col("slug").alias("redirected"))
    return r.join(to, ["owner", "stem"], "left").select("id", "redirected")
