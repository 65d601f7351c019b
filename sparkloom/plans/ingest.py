"""Queries over sources: each lays the rows of a table down in the form of a source and reads them back with its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, text
from ..operators import dedup
from ..runtime import loaded, scratch
from ..sources import directories, documents, openapi, records, sinks
from .common import CURRENT_SQL, LISTED_SQL, current_apis, current_skills, table
from .listings import _SLUG, _host_sql

QUERIES, ORACLES = {}, {}
CUR, LISTED = "WITH " + CURRENT_SQL, "WITH " + LISTED_SQL
#: Deliveries from this moment on are the later part of what is read in two parts.
LATER = "2026-06-01 00:00:00"
_LATE = f"coalesce(ingested_at >= TIMESTAMPTZ '{LATER}+00', false)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _late() -> Column:
    return F.coalesce(F.col("ingested_at") >= F.lit(LATER).cast("timestamp"), F.lit(False))


def _lines(df: DataFrame, order: str, *lines: Column) -> str:
    """Path of a text folder with ``lines`` of every row, in ``order`` over its files."""
    path = scratch(df.sparkSession, "lines")
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return path


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


@query("SELECT id, name, quality_score FROM skills WHERE id IS NOT NULL AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1")
def record_file_scan(spark, d) -> DataFrame:
    """Every delivery as a line, each followed by a cut line, a header and a line without a key: the last good line of an id stays."""
    rows = table(spark, d, "skills").select("row_id", "id", "name", "quality_score")
    broken = F.concat(F.lit('{"id": "'), F.coalesce("id", F.lit("")), F.lit('", "name": '))
    path = _lines(rows, "row_id", _json("id", "name", "quality_score"), broken, F.lit('{"_header": true, "schema_version": 2}'), F.lit('{"id": "", "name": "no key"}'))
    return records.read_records(spark, path, records.schema_of("skill")).select("id", "name", "quality_score")


@query(f"SELECT id, name, row_id FROM skills WHERE id IS NOT NULL AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_LATE} DESC, row_id DESC) = 1")
def record_file_append(spark, d) -> DataFrame:
    """A file with a header, written once and appended to once; what was appended counts as later."""
    rows = table(spark, d, "skills").select("id", "name", "row_id", "ingested_at")
    part = lambda late: rows.where(_late() == F.lit(late)).repartitionByRange("row_id").sortWithinPartitions("row_id").drop("ingested_at")
    path = scratch(spark, "appended")
    sinks.write_records(part(False), path, "skill", 2, LATER)
    sinks.append_records(part(True), path)
    return records.read_records(spark, path, records.T.StructType.fromDDL("id string, name string, row_id long")).select("id", "name", "row_id")


@query(CUR + " SELECT 'header' AS rule, 0 AS broken UNION ALL SELECT 'schema_version', 0 UNION ALL SELECT 'entity_type', 0 UNION ALL SELECT 'malformed', 0 UNION ALL SELECT 'line_size', 0 UNION ALL SELECT 'no_array:tags', count(*) FILTER (tags IS NULL) FROM cur UNION ALL SELECT 'missing:id', 0 UNION ALL SELECT 'missing:name', count(*) FILTER (name IS NULL) FROM cur UNION ALL SELECT 'missing:description', count(*) FILTER (description IS NULL) FROM cur")
def record_round_trip(spark, d) -> DataFrame:
    """What is written is read back line by line and held to its rules."""
    rows = current_skills(spark, d, "name", "description", "tags").select("id", "name", "description", "tags", F.lit(2).alias("schema_version"))
    path = scratch(spark, "round")
    sinks.write_records(rows, path, "skill", 2, LATER)
    return records.verified(spark, path, "skill", 2, required=["id", "name", "description"], arrays=["tags"])


@query("SELECT row_id, id, name FROM apis")
def array_file_rows(spark, d) -> DataFrame:
    path = scratch(spark, "arrays")
    sinks.write_arrays(table(spark, d, "apis").select("row_id", "id", "name"), path, 1000)
    return records.read_array(spark, path, records.T.StructType.fromDDL("row_id long, id string, name string"))


@query("SELECT id, 2 AS schema_version, coalesce(entity_type, 'skill') AS entity_type, 'github' AS source, coalesce(repo_full_name, '') AS source_id, coalesce(repo_url, '') AS home_url, coalesce(repo_stars, 0) AS stars, len(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL)) AS n_tags FROM skills WHERE id IS NOT NULL AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1")
def upcast_rows(spark, d) -> DataFrame:
    """Records of the first version (no version, no origin) read as records of the current one."""
    rows = table(spark, d, "skills").select("row_id", "id", "entity_type", "repo_full_name", "repo_url", "repo_stars", "tags")
    r = records.READERS["skill"](spark, _lines(rows, "row_id", _json("id", "entity_type", "repo_full_name", "repo_url", "repo_stars", "tags")))
    return r.select("id", "schema_version", "entity_type", "origin.source", "origin.source_id", "home_url", F.col("repo_stars").alias("stars"), F.size("tags").alias("n_tags"))


@query("SELECT entity_type, count(*) AS n FROM skills GROUP BY 1")
def first_input(spark, d) -> DataFrame:
    """No override and no first place: the second place is read."""
    here = f"{d}/skills.parquet"
    return spark.read.parquet(records.first_existing(spark, None, f"{d}/absent.ndjson", here, d)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(CUR + " SELECT quality_tier, count(*) AS n, 1 AS builds FROM cur GROUP BY 1")
def loaded_catalog(spark, d) -> DataFrame:
    """The current rows loaded twice and built once."""
    builds, key = [], scratch(spark, "catalog")

    def build() -> DataFrame:
        builds.append(1)
        return current_skills(spark, d, "quality_tier").select("id", "quality_tier")

    loaded(spark, key, build)
    again = loaded(spark, key, build)
    return again.groupBy("quality_tier").agg(F.count(F.lit(1)).alias("n")).withColumn("builds", F.lit(len(builds)))


def _documents(rows: DataFrame, item: Column, of, per: int = 500) -> DataFrame:
    """(text): JSON documents made by ``of`` from arrays of about ``per`` items."""
    parts = max(1, rows.count() // per)
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(item).alias("items")).select(F.to_json(of(F.col("items"))).alias("text"))


_PROVIDER = "coalesce(extra.provider, split_part(id, ':', 1))"
_SERVICE = f"CASE WHEN coalesce(name, '') <> '' AND NOT contains(name, '.') AND {_SLUG('name')} <> 'api' THEN name ELSE split_part({_PROVIDER}, '.', 1) END"


@query(LISTED + f" SELECT id AS source_id, {_SLUG(f'strip_accents({_SERVICE})')} AS name, trim(coalesce(description, '')) AS description, coalesce(home_url, docs_url, 'https://' || {_PROVIDER} || '/') AS home_url, docs_url, extra.spec_version AS spec_version, {_PROVIDER} AS provider, CASE WHEN extra.source_modified_at >= '2026-01-01' THEN extra.source_modified_at END AS source_modified_at FROM listed WHERE extra.spec_version IS NOT NULL")
def map_list_rows(spark, d) -> DataFrame:
    """Listings as maps of versions; those without a specification name a preferred version that is not there, and are skipped."""
    rows = current_apis(spark, d, "name", "description", "home_url", "docs_url", "extra")
    info = F.struct(F.col("description"), F.struct(F.col("home_url").alias("url")).alias("contact"), F.col("extra.provider").alias("x-providerName"), F.col("name").alias("x-serviceName"))
    version = F.struct(info.alias("info"), F.struct(F.col("docs_url").alias("url")).alias("externalDocs"), F.col("extra.spec_version").alias("openapiVer"), F.col("extra.source_modified_at").alias("updated"))
    entry = F.struct(F.when(F.col("extra.spec_version").isNotNull(), "2").otherwise("3").alias("preferred"), F.create_map(F.lit("1"), version, F.lit("2"), version).alias("versions"))
    docs = _documents(rows, F.struct(F.col("id").alias("key"), entry.alias("value")), F.map_from_entries)
    out = directories.parse_map_list(docs, "text", "map", frozen_before="2026-01-01")
    return out.select("source_id", "name", "description", "home_url", "docs_url", "spec_version", "provider", "source_modified_at")


_WHOLE = _SLUG("strip_accents(coalesce(name, ''))")


@query(LISTED + f" SELECT id AS source_id, CASE WHEN regexp_replace({_WHOLE}, '^api-', '') = '' THEN {_WHOLE} ELSE regexp_replace({_WHOLE}, '^api-', '') END AS name, trim(coalesce(description, '')) AS description, coalesce(home_url, '') AS home_url, coalesce(extra.provider, 'portal') AS provider, extra.source_modified_at AS source_modified_at FROM listed WHERE coalesce(access.auth.type, '') NOT IN ('oauth2', 'bearer')")
def page_rows(spark, d) -> DataFrame:
    """Listings as portal pages; what is private or archived is skipped."""
    rows = current_apis(spark, d, "name", "description", "home_url", "extra", "access")
    auth = F.coalesce("access.auth.type", F.lit(""))
    item = F.struct(F.col("name").alias("title"), F.col("id").alias("slug"), "description", F.when(auth == "oauth2", "2026-01-01").alias("archived_at"), (auth == "bearer").alias("private"), F.col("home_url").alias("self_web_url"), F.struct(F.col("extra.provider").alias("slug")).alias("organization"), F.col("extra.source_modified_at").alias("metadata_modified_at"))
    out = directories.parse_pages(_documents(rows, item, lambda x: F.struct(x.alias("data"))), "text", "portal")
    return out.select("source_id", "name", "description", "home_url", "provider", "source_modified_at")


@query("SELECT n AS page, n + 1 AS next_page FROM range(1, 41) t(n)")
def page_cursor(spark, d) -> DataFrame:
    """The next page that each page names; the last names none."""
    pages = spark.range(1, 42).select(F.to_json(F.struct(F.array().cast("array<string>").alias("data"), F.when(F.col("id") < 41, (F.col("id") + 1).cast("string")).alias("next_page"))).alias("text"))
    found = directories.next_page(pages, "text").select(F.col("next_page").cast("long").alias("next_page"))
    return found.select((F.col("next_page") - 1).alias("page"), "next_page")


_HOST = f"regexp_replace({_host_sql('home_url')}, '^www\\.', '')"


@query(LISTED + f" SELECT name AS source_id, {_SLUG('strip_accents(name)')} AS name, trim(coalesce(description, '')) AS description, coalesce(home_url, '') AS home_url, coalesce(nullif({_HOST}, ''), 'open') AS provider, category FROM (SELECT *, nullif(tags[1], '') AS category FROM listed) WHERE coalesce(name, '') <> ''")
def open_list_rows(spark, d) -> DataFrame:
    rows = current_apis(spark, d, "name", "description", "home_url", "tags")
    item = F.struct(F.col("name").alias("API"), F.col("description").alias("Description"), F.col("home_url").alias("Link"), F.get("tags", F.lit(0)).alias("Category"))
    out = directories.parse_open_list(_documents(rows, item, lambda x: F.struct(F.size(x).alias("count"), x.alias("entries"))), "text", "open")
    return out.select("source_id", "name", "description", "home_url", "provider", F.get("categories_src", F.lit(0)).alias("category"))


@query(LISTED + f" SELECT coalesce(nullif(home_url, ''), name) AS source_id, {_SLUG('strip_accents(name)')} AS name, trim(coalesce(nullif(trim(description), ''), 'none')) || chr(10) || 'a \"quoted\" line' AS description, coalesce(nullif(home_url, ''), docs_url, '') AS home_url, nullif(docs_url, '') AS docs_url, coalesce(nullif(extra.provider, ''), 'gov') AS provider, CASE WHEN extra.source_modified_at IS NOT NULL THEN substring(extra.source_modified_at, 1, 10) || 'T00:00:00Z' END AS source_modified_at FROM listed WHERE trim(coalesce(name, '')) <> ''")
def table_rows(spark, d) -> DataFrame:
    """Listings as a government table with quotes and line breaks inside its fields."""
    rows = current_apis(spark, d, "name", "description", "home_url", "docs_url", "extra")
    body = F.concat(F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("none")), F.lit('\na "quoted" line'))
    path = scratch(spark, "table")
    rows.select(F.col("home_url").alias("url"), "name", body.alias("description"), F.col("docs_url").alias("documentation"), F.col("extra.provider").alias("provider"), F.substring("extra.source_modified_at", 1, 10).alias("dateUpdated")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    out = directories.parse_table(directories.read_table(spark, path), "gov")
    return out.select("source_id", "name", "description", "home_url", "docs_url", "provider", "source_modified_at")


def _described(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): an OpenAPI description of each listing, or a Swagger one where its version says so."""
    rows = current_apis(spark, d, "name", "home_url", "docs_url", "extra", "access")
    n = F.coalesce("extra.endpoint_count", F.lit(0)).cast("int")
    media = F.transform(F.coalesce("access.formats", F.array().cast("array<string>")), lambda f: F.concat(F.lit("application/"), f))
    old = F.coalesce(F.startswith("extra.spec_version", F.lit("2")), F.lit(False))
    answer = F.struct(F.when(~old, F.map_from_arrays(media, F.transform(media, lambda _: F.struct(F.lit("x").alias("example"))))).alias("content"))
    op = lambda i: F.struct(F.concat(F.lit("Call "), i.cast("string")).alias("summary"), F.create_map(F.lit("200"), answer).alias("responses"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    paths = F.map_from_entries(F.transform(places, lambda i: F.struct(F.concat(F.lit("/r"), F.lpad(i.cast("string"), 5, "0")).alias("key"), F.create_map(F.when(i % 2 == 0, "post").otherwise("get"), op(i)).alias("value"))))
    scheme = F.when(F.col("access.auth.type").isNotNull(), F.create_map(F.lit("main"), F.struct(F.col("access.auth.type").alias("type"))))
    license_ = F.struct(F.struct(F.col("access.license.spdx").alias("name")).alias("license"), F.col("name").alias("title"))
    spec = F.struct(
        F.when(~old, F.coalesce("extra.spec_version", F.lit("3.1.0"))).alias("openapi"), F.when(old, F.col("extra.spec_version")).alias("swagger"), license_.alias("info"), F.when(~old, F.transform("extra.base_urls", lambda u: F.struct(F.concat(u, F.lit("{v}")).alias("url"), F.create_map(F.lit("v"), F.struct(F.lit("v9").alias("default"))).alias("variables")))).alias("servers"),
        F.when(old, F.nullif(text.host_of(F.col("home_url")), F.lit(""))).alias("host"), F.lit("/base").alias("basePath"), F.when(old, media).alias("produces"), paths.alias("paths"), F.when(~old, F.struct(scheme.alias("securitySchemes"))).alias("components"), F.when(old, scheme).alias("securityDefinitions"),
        F.when(scheme.isNotNull(), F.array(F.create_map(F.lit("main"), F.array().cast("array<string>")))).alias("security"), F.struct(F.col("docs_url").alias("url")).alias("externalDocs"),
    )
    return rows.select("id", F.to_json(spec).alias("text"))


_OLD = "coalesce(starts_with(extra.spec_version, '2'), false)"


@query(LISTED + f" SELECT id, CASE WHEN {_OLD} THEN 'swagger' ELSE 'openapi' END AS standard, coalesce(extra.spec_version, '3.1.0') AS version, name AS title, access.license.spdx AS licence, docs_url AS documentation, CASE WHEN {_OLD} THEN CASE WHEN {_host_sql('home_url')} <> '' THEN ['https://' || {_host_sql('home_url')} || '/base'] ELSE [] END ELSE list_transform(coalesce(extra.base_urls, []), lambda u: u || 'v9') END AS servers, coalesce(extra.endpoint_count, 0) AS operations, "
       f"CASE WHEN {_OLD} OR coalesce(extra.endpoint_count, 0) > 0 THEN list_sort(list_distinct(list_transform(coalesce(access.formats, []), lambda f: 'application/' || f))) ELSE [] END AS media, access.auth.type AS auth, CASE WHEN access.auth.type IS NULL THEN 0 ELSE 1 END AS needs FROM listed")  # fmt: skip
def api_profiles(spark, d) -> DataFrame:
    r = _described(spark, d).select("id", openapi.api_profile(F.col("text")).alias("p"))
    return r.select("id", "p.standard", "p.version", "p.title", "p.licence", "p.documentation", "p.servers", "p.operations", "p.media", F.get("p.auth", F.lit(0))["kind"].alias("auth"), F.size("p.needs").alias("needs"))


@query(LISTED + " SELECT id, i AS place, '/r' || lpad(i::VARCHAR, 5, '0') AS path, CASE WHEN i % 2 = 0 THEN 'post' ELSE 'get' END AS method, 'Call ' || i AS headline FROM (SELECT id, unnest(range(1, coalesce(extra.endpoint_count, 0) + 1)) AS i FROM listed)")
def api_operation_rows(spark, d) -> DataFrame:
    return openapi.api_operations(_described(spark, d), "id", "text").withColumnRenamed("key", "id")


@query(CUR + " SELECT id, substring(regexp_replace(regexp_replace(lower(trim(coalesce(name, 'x'))), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), 1, 64) AS name, substring(trim(regexp_replace(coalesce(nullif(description, ''), 'none given'), '\\s+', ' ', 'g')), 1, 1024) AS description, length(trim(coalesce(body_markdown, ''))) AS body_length FROM cur")
def skill_documents(spark, d) -> DataFrame:
    """Records as documents with frontmatter, parsed back."""
    rows = current_skills(spark, d, "name", "description", "body_markdown")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 2**30)
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.regexp_replace(quoted(c), r"\]$", ""), F.lit("\n"))
    whole = F.concat(F.lit("---\n"), line("name", F.coalesce("name", F.lit("x"))), line("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("none given"))), F.lit("---\n"), F.coalesce("body_markdown", F.lit("")))
    docs = rows.select("id", whole.alias("text"), F.concat("id", F.lit("/SKILL.md")).alias("path"))
    return documents.parse_skill_documents(docs, "text", "path").select("id", "name", "description", F.length("body").alias("body_length"))


@query("WITH p AS (SELECT row_id, array_to_string(list_transform(string_split_regex(body_markdown, '\\r?\\n'), lambda x: CASE WHEN trim(x) = '' OR regexp_matches(trim(x), '^(#|---|\\||```|~~~)') THEN chr(1) ELSE trim(x) END), chr(10)) AS p FROM skills WHERE body_markdown IS NOT NULL) SELECT row_id, substring(trim(replace(regexp_extract(p, '(?:^|\\n|\\x01)([^\\x01\\n][^\\x01]*)', 1), chr(10), ' ')), 1, 500) AS paragraph FROM p")
def first_paragraphs(spark, d) -> DataFrame:
    return table(spark, d, "skills").where("body_markdown is not null").select("row_id", text.first_paragraph(F.col("body_markdown")).alias("paragraph"))


@query("SELECT row_id, name || ' A< &copy; é' AS decoded FROM apis WHERE name IS NOT NULL")
def decoded_names(spark, d) -> DataFrame:
    """Names with their marks written as entities, decoded; an entity that is not common stays."""
    r = table(spark, d, "apis").where("name is not null")
    written_as = F.concat(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit("&nbsp;&#x41;&lt;&nbsp;&copy;&nbsp;&#233;"))
    return r.select("row_id", text.decode_entities(written_as).alias("decoded"))


_NORM = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g'))"
_CASES = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SPDX_NAMES.items()) + " END"
_BARE = "regexp_replace(lower(trim(l)), '\\s+licen[cs]e$', '')"


@query(CUR + f", f AS (SELECT id, form, CASE form WHEN 0 THEN repo_license WHEN 1 THEN repo_license || ' License' ELSE 'https://spdx.org/licenses/' || repo_license || '.html' END AS l FROM cur, range(3) t(form)) SELECT id, form, coalesce({_CASES(_NORM.format(c=_BARE))}, {_CASES(_NORM.format(c='l'))}, nullif(regexp_extract(l, 'spdx\\.org/licenses/([A-Za-z0-9.+-]+)', 1), '')) AS spdx FROM f")
def licence_ids(spark, d) -> DataFrame:
    """Licences written as an id, as a name and as an address."""
    l = F.col("repo_license")
    forms = F.array(l, F.concat(l, F.lit(" License")), F.concat(F.lit("https://spdx.org/licenses/"), l, F.lit(".html")))
    r = current_skills(spark, d, "repo_license").select("id", F.posexplode(forms).alias("form", "l"))
    return r.select("id", "form", text.spdx_of(F.col("l")).alias("spdx"))


@query(LISTED + ", t AS (SELECT id, coalesce(access.auth.type, 'unknown') AS t, coalesce(access.cost.model = 'free', false) AS asks FROM listed) SELECT id, CASE WHEN asks AND t <> 'unknown' THEN t WHEN t IN ('api_key', 'bearer', 'oauth2') THEN t ELSE 'http_basic' END AS auth FROM t")
def required_auth(spark, d) -> DataFrame:
    """The scheme that is required decides; else the first known one in the fixed order."""
    r = current_apis(spark, d, "access")
    scheme = lambda name, kind: F.struct(F.lit(name).alias("name"), kind.alias("type"))
    schemes = F.array(scheme("second", F.lit("http_basic")), scheme("main", F.coalesce("access.auth.type", F.lit("unknown"))))
    asks = F.when(F.col("access.cost.model") == "free", F.array(F.lit("absent"), F.lit("main"))).otherwise(F.array().cast("array<string>"))
    return r.select("id", access.scheme_of(schemes, asks).alias("auth"))


_FOLDER = {"command_lib": "commands", "agent_lib": "agents", "skill": "skills", "hook_lib": "hooks", "mcp_server": "mcp"}
_FOLDER_SQL = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOLDER.items()) + " ELSE 'docs' END"
_TREE = CUR + f", t AS (SELECT repo_full_name AS id, {_FOLDER_SQL} AS folder, length(name) % 3 AS root, name || '.json' AS component FROM cur WHERE repo_full_name IS NOT NULL AND name IS NOT NULL AND {_FOLDER_SQL} <> 'docs'), f AS (SELECT DISTINCT id, folder, component FROM t QUALIFY root = min(root) OVER (PARTITION BY id, folder)) "


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r = current_skills(spark, d, "entity_type", "name", "repo_full_name").where("repo_full_name is not null and name is not null")
    folder = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _FOLDER.items() for x in kv]), F.col("entity_type")), F.lit("docs"))
    root = F.element_at(F.array(*[F.lit(x) for x in documents.ROOTS]), (F.length("name") % 3 + 1).cast("int"))
    return r.select(F.col("repo_full_name").alias("id"), F.concat(root, folder, F.lit("/"), "name", F.lit(".json/x")).alias("path"))


@query(_TREE + "SELECT * FROM f")
def component_tree(spark, d) -> DataFrame:
    """Components by folder from the paths of each repository; of several roots the first counts."""
    return documents.components(_tree(spark, d), "id", "path")


@query(_TREE + "SELECT 'mcp_server:' || id || '/' || component AS id, 'mcp_server' AS entity_type, regexp_replace(component, '\\.json$', '') AS name, id AS repo_full_name FROM f WHERE folder = 'mcp'")
def server_records(spark, d) -> DataFrame:
    return records.servers_of(documents.components(_tree(spark, d), "id", "path"))


@query(CUR + ", r AS (SELECT repo_full_name AS repo, min(name) FILTER (entity_type = 'plugin') AS plugin, min(description) FILTER (entity_type = 'plugin') AS about, min(description) AS described, count(*) FILTER (entity_type = 'mcp_server') AS listed FROM cur WHERE repo_full_name IS NOT NULL GROUP BY 1) SELECT 'plugin:' || repo AS id, coalesce(nullif(plugin, ''), split_part(repo, '/', -1)) AS name, coalesce(nullif(about, ''), described) AS description, least(listed, 1) AS listed FROM r WHERE plugin IS NOT NULL OR listed > 0")
def plugin_records(spark, d) -> DataFrame:
    """Plugins of repositories with a manifest (made of their first plugin) or a listing (made of their first server)."""
    r = current_skills(spark, d, "entity_type", "name", "description", "repo_full_name").where("repo_full_name is not null")
    plugin = F.col("entity_type") == "plugin"
    repos = r.groupBy("repo_full_name").agg(F.min(F.when(plugin, F.col("name"))).alias("p"), F.min(F.when(plugin, F.col("description"))).alias("about"), F.min("description").alias("description"), F.min(F.when(F.col("entity_type") == "mcp_server", F.col("name"))).alias("s"))
    manifest = F.when(F.col("p").isNotNull(), F.map_filter(F.create_map(F.lit("name"), F.col("p"), F.lit("description"), F.col("about")), lambda _, v: v.isNotNull()))
    repos = repos.select("repo_full_name", "description", manifest.alias("manifest"), F.when(F.col("s").isNotNull(), F.array(F.struct(F.lit(".").alias("path"), F.col("s").alias("name")))).alias("listings"))
    return records.plugins_of(repos).select("id", "name", "description", "listed")


@query(CUR + " SELECT '2026-02-01' AS snapshot_date, repo_full_name, max(repo_stars) AS s, max(repo_forks) AS f, max(repo_open_issues) AS i, max(repo_pushed_at) AS p FROM cur WHERE repo_full_name IS NOT NULL AND NOT coalesce(repo_archived, false) GROUP BY 2")
def pulse_snapshot(spark, d) -> DataFrame:
    r = current_skills(spark, d, "repo_full_name", "repo_stars", "repo_forks", "repo_open_issues", "repo_pushed_at", "repo_archived")
    return records.pulse_rows(r.select("repo_full_name", F.col("repo_stars").alias("stars"), F.col("repo_forks").alias("forks"), F.col("repo_open_issues").alias("open_issues"), F.col("repo_pushed_at").alias("pushed_at"), F.col("repo_archived").alias("archived"), F.lit(False).alias("fork")), "2026-02-01").withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("SELECT snapshot_date::VARCHAR AS snapshot_date, repo_full_name, s, f, i FROM repo_pulse WHERE snapshot_date IS NOT NULL")
def snapshot_files(spark, d) -> DataFrame:
    """One folder of lines for each day; what does not carry a date is skipped."""
    path = scratch(spark, "snapshots")
    rows = table(spark, d, "repo_pulse").select(F.concat(F.col("snapshot_date").cast("string"), F.lit(".json")).alias("day"), "repo_full_name", "s", "f", "i")
    rows.where("day is not null").repartition("day").write.partitionBy("day").json(path)
    rows.where("day is not null").limit(5).drop("day").write.json(f"{path}/day=latest.json")
    schema = records.T.StructType.fromDDL("repo_full_name string, s long, f long, i long")
    return records.read_snapshots(spark, path, schema, lines=True).select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "repo_full_name", "s", "f", "i")


@query(CUR + " SELECT id, row_id, quality_score FROM cur")
def checkpoint_merge(spark, d) -> DataFrame:
    """What a broken run had stored, merged with what the next one found."""
    rows = table(spark, d, "skills").select("id", "row_id", "quality_score", "scraped_at", "ingested_at")
    return sinks.upsert(rows.where(~_late()), rows.where(_late()), ["id"], [F.col("scraped_at"), F.col("row_id")]).where("id is not null").select("id", "row_id", "quality_score")


@query(LISTED + f", prior AS (SELECT DISTINCT origin.source AS source, id, content_sha FROM apis WHERE NOT {_LATE}) SELECT l.origin.source AS source, count(*) AS n, count(p.id) AS reused FROM listed l LEFT JOIN prior p ON p.source = l.origin.source AND p.id = l.id AND p.content_sha = l.content_sha GROUP BY 1")
def harvest_reuse(spark, d) -> DataFrame:
    """The directories together, each with the least it must give, and how many listings are as they were delivered before."""
    rows = current_apis(spark, d, "origin", "content_sha").select(F.col("origin.source").alias("source"), F.col("id").alias("source_id"), "content_sha")
    prior = table(spark, d, "apis").where(~_late()).select(F.col("origin.source").alias("source"), F.col("id").alias("source_id"), "content_sha")
    names = [r[0] for r in rows.select("source").distinct().collect()]  # one row per directory
    out = directories.harvest([rows.where(F.col("source").eqNullSafe(F.lit(n))) for n in names] or [rows], prior, dict.fromkeys((n for n in names if n), 1))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("reused").alias("reused"))


@query(CUR + ", " + LISTED_SQL + f" SELECT id, CASE entity_type WHEN 'plugin' THEN entity_type || ':' || repo_full_name ELSE entity_type || ':' || concat_ws('/', repo_full_name, nullif(name, '')) END AS made FROM cur WHERE entity_type IN ('skill', 'plugin', 'mcp_server') AND repo_full_name IS NOT NULL UNION ALL SELECT id, 'api:' || {_host_sql('home_url')} || '/' || name FROM listed UNION ALL SELECT id, 'dataset:' || origin.source || '/' || origin.source_id FROM listed")
def record_ids(spark, d) -> DataFrame:
    """Ids by type: repository and path, host and name, source and id."""
    none = F.lit(None).cast("string")
    skills = current_skills(spark, d, "entity_type", "repo_full_name", "name").where("entity_type in ('skill', 'plugin', 'mcp_server') and repo_full_name is not null")
    path = F.when(F.col("entity_type") != "plugin", F.col("name"))
    one = skills.select("id", records.record_id(F.col("entity_type"), F.col("repo_full_name"), path, none, none, none, none).alias("made"))
    apis = current_apis(spark, d, "origin", "home_url", "name")
    of = lambda kind: apis.select("id", records.record_id(F.lit(kind), none, none, F.col("origin.source"), F.col("origin.source_id"), text.host_of(F.col("home_url")), F.col("name")).alias("made"))
    return one.unionByName(of("api")).unionByName(of("dataset"))


_SCRIPT = """-- stars of each repository; the greatest state counts
CREATE OR REPLACE TEMPORARY VIEW script_stars AS SELECT repo_full_name, max(s) AS s FROM script_pulse GROUP BY repo_full_name; -- per repository
CREATE OR REPLACE TEMPORARY VIEW script_bands AS SELECT CASE WHEN s >= 100 THEN 'many' WHEN s >= 10 THEN 'some' ELSE 'few' END AS band FROM script_stars;

SELECT band, count(*) AS n FROM script_bands GROUP BY band
"""


@query("WITH s AS (SELECT repo_full_name, max(s) AS s FROM repo_pulse GROUP BY 1) SELECT CASE WHEN s >= 100 THEN 'many' WHEN s >= 10 THEN 'some' ELSE 'few' END AS band, count(*) AS n FROM s GROUP BY 1")
def script_result(spark, d) -> DataFrame:
    """A script of several statements with comments, run in order; the last one is the result."""
    table(spark, d, "repo_pulse").createOrReplaceTempView("script_pulse")
    return records.run_script(spark, _SCRIPT)


@query(CUR + ", " + LISTED_SQL + " SELECT entity_type, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, entity_type FROM cur WHERE entity_type IN ('skill', 'plugin', 'mcp_server') AND id <> '' UNION ALL SELECT id, entity_type FROM listed WHERE id <> '') GROUP BY 1")
def reader_union(spark, d) -> DataFrame:
    """A file of each type through the reader registered for it, all in one table."""
    skills = current_skills(spark, d, "entity_type", "name").select("id", "entity_type", "name")
    parts = []
    for kind in ("skill", "plugin", "mcp_server"):
        path = scratch(spark, kind)
        sinks.write_records(skills.where(F.col("entity_type") == kind), path, kind, 2, LATER)
        parts.append(records.READERS[kind](spark, path))
    path = scratch(spark, "api")
    sinks.write_records(current_apis(spark, d, "entity_type", "name").select("id", "entity_type", "name"), path, "api", 2, LATER)
    parts.append(records.READERS["api"](spark, path))
    return records.union_types(parts).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


#: A step of the generator in SQL: 32-bit products in two halves, so that nothing overflows.
_MUL = lambda a, b: f"((({a}) & 65535) * ({b}) + (((((({a}) >> 16) * (({b}) & 65535)) & 65535) << 16))) & 4294967295"


def _draws(numbers: str, seed: int) -> str:
    """SQL for (i, k, draw) of ``numbers`` (i, k, n), n being what is drawn for."""
    return f"a AS (SELECT i, k, (n * 1831565813 + {seed} + 1831565813) & 4294967295 AS t FROM ({numbers})), b AS (SELECT i, k, {_MUL('xor(t, t >> 15)', 't | 1')} AS u FROM a), c AS (SELECT i, k, xor(u, (u + ({_MUL('xor(u, u >> 7)', 'u | 61')})) & 4294967295) AS v FROM b), draws AS (SELECT i, k, xor(v, v >> 14) AS draw FROM c)"


@query(f"WITH {_draws('SELECT i, 0 AS k, i AS n FROM range(2000) r(i)', 7)} SELECT i AS id, draw FROM draws")
def seeded_draws(spark, d) -> DataFrame:
    """The generator behind made-up records: the same draw for the same row and seed."""
    return spark.range(2000).select("id", records.draw(F.col("id"), 7).alias("draw"))


@query(f"WITH {_draws('SELECT i, k, i * 4 + k AS n FROM range(5000) r(i), range(1, 5) q(k)', 1)}, u AS (SELECT i, max(draw) FILTER (k = 1) / 4294967296.0::DOUBLE AS u1, max(draw) FILTER (k = 2) / 4294967296.0::DOUBLE AS u2, max(draw) FILTER (k = 4) / 4294967296.0::DOUBLE AS u4 FROM draws GROUP BY 1), r AS (SELECT i % 8 AS c, CASE WHEN u1 < 0.05 THEN 'featured' WHEN u1 < 0.3 THEN 'solid' ELSE 'listed' END AS tier, CASE WHEN u1 < 0.05 THEN 80 + floor(u2 * 21) WHEN u1 < 0.3 THEN 50 + floor(u2 * 30) ELSE floor(u2 * 50) END AS score, floor(u4 * u4 * 5000) AS stars FROM u) SELECT tier, 'category-' || c AS category, count(*) AS n, sum(score)::BIGINT AS score, sum(stars)::BIGINT AS stars FROM r GROUP BY 1, 2")
def made_up_catalog(spark, d) -> DataFrame:
    r = records.synthetic_records(spark, 5000)
    return r.groupBy(F.col("quality_tier").alias("tier"), "category").agg(F.count(F.lit(1)).alias("n"), F.sum("quality_score").alias("score"), F.sum("repo_stars").alias("stars"))


@query("SELECT repo_full_name AS repo, count(*) AS files FROM (SELECT DISTINCT repo_full_name, id FROM skills WHERE ends_with(id, '/SKILL.md') AND repo_full_name IS NOT NULL) GROUP BY 1")
def tree_files(spark, d) -> DataFrame:
    """Skill files in the listing of each repository."""
    r = dedup.first_per_key(table(spark, d, "skills").where(F.endswith("id", F.lit("/SKILL.md")) & F.col("repo_full_name").isNotNull()).select("repo_full_name", "id"), ["repo_full_name", "id"], [F.col("id")])
    return r.groupBy(F.col("repo_full_name").alias("repo")).agg(F.count(F.lit(1)).alias("files"))
