"""Queries over API listings: keys, merge, scores, labels, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scoring, text
from ..operators import dedup, ranking, reports
from .common import AS_OF, LISTED_SQL, current_apis

QUERIES, ORACLES = {}, {}
WITH = "WITH " + LISTED_SQL
TS = f"TIMESTAMPTZ '{AS_OF}+00'"
#: Sources in order of precedence.
PRECEDENCE = ["specdeck", "portail-ouvert", "civic-catalogue", "open-list"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _host_sql(u: str) -> str:
    return f"coalesce(regexp_extract(lower({u}), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')"


_LABELS = "|".join(text.HOST_LABELS)
_CANON = f"regexp_replace({{h}}, '^(?:{_LABELS})\\.([^.]+\\..+)$', '\\1')"
_SLUG = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STEM = f"nullif(CASE WHEN regexp_replace(regexp_replace({_SLUG('name')}, '^api-', ''), '-api$', '') = 'api' THEN '' ELSE regexp_replace(regexp_replace({_SLUG('name')}, '^api-', ''), '-api$', '') END, '')"
_KEYS = f"k AS (SELECT *, {_host_sql('home_url')} AS host, {_CANON.format(h=_host_sql('home_url'))} AS canonical, {_STEM} AS stem, nullif({_CANON.format(h=_host_sql('home_url'))}, '') || '/' || {_STEM} AS mkey FROM listed)"


@query(WITH + ", " + _KEYS + " SELECT id, host, canonical, stem, mkey AS merge_key FROM k")
def url_keys(spark, d) -> DataFrame:
    r = current_apis(spark, d, "name", "home_url")
    host = text.host_of(F.col("home_url"))
    return r.select("id", host.alias("host"), text.canonical_host(host).alias("canonical"), text.name_stem(F.col("name")).alias("stem"), text.merge_key(F.col("home_url"), F.col("name")).alias("merge_key"))


_RANK = "CASE origin.source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRECEDENCE)) + f" ELSE {len(PRECEDENCE)} END"
#: Provider and offering make a coarse key here, so that the merge has groups to work on.
_GROUP = "lower(split_part(name, ' ', 1))"


@query(
    WITH + f", g AS (SELECT *, {_GROUP} AS gk, row_number() OVER w AS p FROM listed WINDOW w AS (PARTITION BY {_GROUP} ORDER BY {_RANK}, coalesce(extra.source_modified_at, '') DESC, origin.source_id)) "
    "SELECT gk AS merge_key, arg_min(id, p) AS id, arg_min(origin.source, p) AS source, coalesce(arg_min(CASE WHEN nullif(description, '') NOT IN ('unknown') THEN description END, p) , arg_min(description, p)) AS description, arg_min(docs_url, p) AS docs_url, "
    "arg_min(access.auth.type, p) AS auth, list_sort(list_filter(list_distinct(list(origin.source)), lambda s: s <> arg_min(origin.source, p))) AS also_listed_in, count(*) AS merged FROM g GROUP BY gk"
)
def entity_merge(spark, d) -> DataFrame:
    r = current_apis(spark, d, "name", "description", "docs_url", "origin", "extra", "access")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("origin.source")), F.lit(0))
    r = r.select("id", F.lower(F.element_at(F.split("name", " "), 1)).alias("merge_key"), F.col("origin.source").alias("source"), "description", "docs_url", F.col("access.auth.type").alias("auth"), F.when(rank == 0, len(PRECEDENCE)).otherwise(rank - 1).alias("rank"), F.col("extra.source_modified_at").try_cast("timestamp").alias("modified"), F.col("origin.source_id").alias("source_id"))
    newest = F.coalesce(-F.unix_micros("modified"), F.lit(2**62))
    out = dedup.absorb(r, "merge_key", [F.col("rank"), newest, F.col("source_id")], ["description", "docs_url", "auth"], [], "source")
    return out.select("merge_key", "id", "source", "description", "docs_url", "auth", "also_listed_in", "merged")


@query(WITH + ", x AS (SELECT lower(name) AS id, origin.source AS s, origin.source_id AS sid FROM listed) SELECT CASE WHEN row_number() OVER (PARTITION BY id ORDER BY s, sid) > 1 THEN id || '~' || s || '-' || sid ELSE id END AS id FROM x")
def id_collisions(spark, d) -> DataFrame:
    r = current_apis(spark, d, "name", "origin").select(F.lower("name").alias("id"), F.col("origin.source").alias("s"), F.col("origin.source_id").alias("sid"))
    return dedup.suffix_collisions(r, "id", [F.col("s"), F.col("sid")], F.concat_ws("-", "s", "sid")).select("id")


_KNOWN = lambda c: f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN ('', 'unknown') THEN 1.0 ELSE 0.0 END"
_MOD = f"(epoch({TS}) - epoch(try_cast(extra.source_modified_at AS TIMESTAMPTZ))) / 86400.0"
_DESC = "CASE WHEN coalesce(length(description), 0) > 50 THEN 100 WHEN coalesce(length(description), 0) > 20 THEN 60 WHEN coalesce(length(description), 0) > 0 THEN 30 ELSE 0 END"
_FEED = f"""s AS (SELECT id, name, origin.source AS source, extra.provider AS provider, access.auth.type AS auth, ({_KNOWN('access.auth.type')} + {_KNOWN('access.cost.model')}) / 3 AS clarity,
  least(100.0::DOUBLE, CASE WHEN length(docs_url) > 0 THEN 40 ELSE 0 END + CASE WHEN extra.spec_version IS NOT NULL THEN 40 ELSE 0 END + {_DESC} * 0.2::DOUBLE) AS docs,
  CASE WHEN access.license.spdx IS NULL OR access.license.spdx IN ('', 'NOASSERTION') THEN 0 WHEN access.license.spdx IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'Unlicense', '0BSD') THEN 100 ELSE 70 END AS license,
  CASE WHEN extra.source_modified_at IS NULL THEN 50 WHEN {_MOD} IS NULL THEN 0 WHEN {_MOD} <= 7 THEN 100 WHEN {_MOD} <= 30 THEN 90 WHEN {_MOD} <= 90 THEN 75 WHEN {_MOD} <= 180 THEN 50 WHEN {_MOD} <= 365 THEN 25 ELSE 5 END AS freshness FROM listed),
  f AS (SELECT *, floor(least(100::DOUBLE, (clarity * 100)::DOUBLE * 0.20::DOUBLE + 70 * 0.15::DOUBLE + docs * 0.15::DOUBLE + license * 0.15::DOUBLE + freshness * 0.15::DOUBLE + 50 * 0.15::DOUBLE) + 0.5::DOUBLE)::BIGINT AS score FROM s)"""


def _feed(spark, d) -> DataFrame:
    r = current_apis(spark, d, "name", "description", "docs_url", "origin", "access", "extra")
    c = F.col
    r = r.withColumn("clarity", scoring.access_clarity(c("access.auth.type"), c("access.cost.model"), F.lit(None).cast("string")))
    signals = {
        "access": c("clarity") * 100,
        "reachability": F.lit(scoring.NEUTRAL_REACHABILITY),
        "docs": scoring.feed_docs(c("docs_url"), c("extra.spec_version").isNotNull(), c("description")),
        "license": scoring.license_score(c("access.license.spdx")),
        "freshness": F.when(c("extra.source_modified_at").isNull(), scoring.NEUTRAL_FRESHNESS).otherwise(scoring.recency(c("extra.source_modified_at"), AS_OF)),
        "popularity": F.lit(scoring.NEUTRAL_POPULARITY),
        "adoption": scoring.adoption(F.lit(None).cast("int")),
    }
    return r.select("id", "name", c("origin.source").alias("source"), c("extra.provider").alias("provider"), c("access.auth.type").alias("auth"), "clarity", signals["docs"].alias("docs"), signals["license"].alias("license"), signals["freshness"].alias("freshness"), scoring.weighted(signals, scoring.FEED_WEIGHTS).alias("score"))


@query(WITH + ", " + _FEED + " SELECT id, round(clarity, 6)::DOUBLE AS clarity, docs, license, freshness, score FROM f")
def feed_scores(spark, d) -> DataFrame:
    return _feed(spark, d).select("id", F.round("clarity", 6).alias("clarity"), "docs", "license", "freshness", "score")


@query(WITH + ", " + _FEED + ", b AS (SELECT unnest(range(10))::INT AS bin), h AS (SELECT least(9, greatest(0, floor(clarity * 10)))::INT AS bin, count(*) AS n FROM f GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)")
def clarity_histogram(spark, d) -> DataFrame:
    return reports.histogram(_feed(spark, d), F.col("clarity"))


@query(WITH + " SELECT count(*) AS listings, round(avg(CASE WHEN access.cost.model = 'free' THEN 100.0 ELSE 0.0 END), 4)::DOUBLE AS pct_free, round(avg(CASE WHEN access.auth.type = 'none' THEN 100.0 ELSE 0.0 END), 4)::DOUBLE AS pct_no_auth, round(avg(CASE WHEN access.auth.type IS NOT NULL THEN 100.0 ELSE 0.0 END), 4)::DOUBLE AS pct_auth_known, round(avg(CASE WHEN extra.spec_version IS NOT NULL THEN 100.0 ELSE 0.0 END), 4)::DOUBLE AS pct_spec, count(DISTINCT lower(extra.provider)) AS providers FROM listed")
def listing_stats(spark, d) -> DataFrame:
    pct = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 4)
    a, e = "access", "extra"
    return current_apis(spark, d, a, e).agg(
        F.count(F.lit(1)).alias("listings"), pct(F.col("access.cost.model") == "free").alias("pct_free"), pct(F.col("access.auth.type") == "none").alias("pct_no_auth"), pct(F.col("access.auth.type").isNotNull()).alias("pct_auth_known"),
        pct(F.col("extra.spec_version").isNotNull()).alias("pct_spec"), F.count_distinct(F.lower("extra.provider")).alias("providers"),
    )


_API_REASON = "CASE WHEN length(trim(coalesce(description, ''))) < 50 THEN 'short_description' WHEN coalesce(home_url, '') = '' THEN 'no_home' WHEN len(coalesce(extra.base_urls, [])) = 0 AND extra.spec_version IS NULL THEN 'no_endpoint' END"


@query(WITH + f", r AS (SELECT origin.source AS source, {_API_REASON} AS reason FROM listed) SELECT source, count(*) AS raw, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'short_description') AS short_description, count(*) FILTER (reason = 'no_home') AS no_home, count(*) FILTER (reason = 'no_endpoint') AS no_endpoint FROM r GROUP BY 1")
def kept_by_source(spark, d) -> DataFrame:
    r = current_apis(spark, d, "description", "home_url", "origin", "extra").select(F.col("origin.source").alias("source"), rules.first_reason(rules.api_gates()).alias("reason"))
    of = lambda x: F.count_if(F.col("reason") == x).alias(x)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), of("short_description"), of("no_home"), of("no_endpoint"))


@query(WITH + ", " + _FEED + " SELECT source, count(*) FILTER (score >= 60) AS high, count(*) FILTER (score >= 45 AND score < 60) AS middle, count(*) FILTER (score < 45) AS low, round(avg(clarity), 6)::DOUBLE AS mean_clarity, round(avg(docs), 6)::DOUBLE AS mean_docs, round(avg(freshness), 6)::DOUBLE AS mean_freshness FROM f GROUP BY 1")
def calibration(spark, d) -> DataFrame:
    f = _feed(spark, d).withColumn("tier", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 45, "middle").otherwise("low"))
    tiers = f.groupBy("source").pivot("tier", ["high", "middle", "low"]).agg(F.count(F.lit(1))).na.fill(0)
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return tiers.join(f.groupBy("source").agg(mean("clarity"), mean("docs"), mean("freshness")), "source")


@query(WITH + ", " + _FEED + ", t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, name, id) AS turn FROM f) SELECT id, turn FROM t ORDER BY turn, score DESC, name, id LIMIT 12")
def round_robin_top(spark, d) -> DataFrame:
    f = _feed(spark, d).select("id", "name", "source", "score")
    return ranking.round_robin(f, "source", [F.desc("score"), F.asc("name"), F.asc("id")], 12).select("id", F.col("turn").cast("long").alias("turn"))


@query(WITH + ", " + _FEED + ", t AS (SELECT id, lower(provider) AS p, score, row_number() OVER (PARTITION BY lower(provider) ORDER BY score DESC, id) AS r FROM f WHERE provider IS NOT NULL) SELECT a.id, b.id AS sibling, row_number() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.id) AS place FROM t a JOIN t b ON a.p = b.p AND a.id <> b.id AND b.r <= 7 QUALIFY place <= 6")
def siblings(spark, d) -> DataFrame:
    f = _feed(spark, d).where("provider is not null").select("id", F.lower("provider").alias("p"), "score")
    # The six best others of a provider are among its first seven.
    top = dedup.first_per_key(f, ["p"], [F.desc("score"), F.asc("id")], 7)
    lists = top.groupBy("p").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("top"))
    rows = f.join(lists, "p").select("id", F.posexplode(F.slice(F.filter("top", lambda x: x.id != F.col("id")), 1, 6)).alias("i", "t"))
    return rows.select("id", F.col("t.id").alias("sibling"), (F.col("i") + 1).cast("long").alias("place"))


def _lookup_sql(value: str, table: dict) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_NORM = "trim(regexp_replace(lower(trim(access.license.spdx)), '[^a-z0-9]+', ' ', 'g'))"


@query(WITH + f" SELECT id, {_lookup_sql(_NORM, text.SPDX_NAMES)} AS spdx, list_transform(coalesce(access.formats, []), lambda f: 'application/' || f) AS media, CASE access.auth.type WHEN 'none' THEN 'none' WHEN 'api_key' THEN 'api_key' WHEN 'oauth2' THEN 'oauth2' ELSE 'unknown' END AS auth FROM listed")
def access_fields(spark, d) -> DataFrame:
    r = current_apis(spark, d, "access")
    as_listed = F.when(F.col("access.auth.type") == "none", "No").when(F.col("access.auth.type") == "api_key", "apiKey").when(F.col("access.auth.type") == "oauth2", "OAuth").otherwise(F.coalesce("access.auth.type", F.lit("?")))
    return r.select("id", text.spdx_of(F.col("access.license.spdx")).alias("spdx"), F.transform(F.coalesce("access.formats", F.array().cast("array<string>")), lambda f: F.concat(F.lit("application/"), f)).alias("media"), text.listed_auth(as_listed).alias("auth"))


@query(WITH + " SELECT id, list_sort(list_distinct(list_filter(list_transform(coalesce(access.formats, []), lambda f: CASE f WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'pdf' THEN 'pdf' WHEN 'zip' THEN 'zip' WHEN 'yaml' THEN 'yaml' END), lambda x: x IS NOT NULL))) AS formats FROM listed")
def media_formats(spark, d) -> DataFrame:
    media = F.transform(F.coalesce("access.formats", F.array().cast("array<string>")), lambda f: F.concat(F.lit("application/"), f, F.lit("; charset=utf-8")))
    return current_apis(spark, d, "access").select("id", F.array_sort(text.media_formats(media)).alias("formats"))


@query(WITH + " SELECT id, (50 + extra.endpoint_count)::BIGINT AS requests, CASE WHEN extra.endpoint_count % 2 = 0 THEN 'minute' ELSE 'hour' END AS per FROM listed WHERE extra.endpoint_count IS NOT NULL")
def rate_limits(spark, d) -> DataFrame:
    r = current_apis(spark, d, "extra").where("extra.endpoint_count is not null")
    n = (50 + F.col("extra.endpoint_count")).cast("string")
    told = F.when(F.col("extra.endpoint_count") % 2 == 0, F.concat(F.lit("quota de "), n, F.lit(" appels par minute"))).otherwise(F.concat(n, F.lit(" requests/hour")))
    return r.select("id", text.rate_limit(told).alias("l")).select("id", "l.requests", "l.per")


@query(WITH + " SELECT id, 'cost' AS field, coalesce(access.cost.model, 'unknown') AS value FROM listed UNION ALL SELECT id, 'auth', coalesce(access.auth.type, 'unknown') FROM listed UNION ALL SELECT id, 'license', coalesce(access.license.spdx, 'unknown') FROM listed")
def access_rows(spark, d) -> DataFrame:
    one = lambda c: F.coalesce(c, F.lit("unknown"))
    r = current_apis(spark, d, "access").select("id", one(F.col("access.cost.model")).alias("cost"), one(F.col("access.auth.type")).alias("auth"), one(F.col("access.license.spdx")).alias("license"))
    return r.unpivot("id", ["cost", "auth", "license"], "field", "value")


@query(WITH + " SELECT id, regexp_replace(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM listed")
def folded_slugs(spark, d) -> DataFrame:
    return current_apis(spark, d, "name").select("id", text.slug(text.fold_accents(F.lower("name"))).alias("slug"))


@query(WITH + " SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT array_has([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w)))) AS w FROM listed) GROUP BY 1 ORDER BY n DESC, word LIMIT 25")
def top_words(spark, d) -> DataFrame:
    r = current_apis(spark, d, "description").select(F.explode(F.array_distinct(text.words(F.col("description")))).alias("word"))
    return r.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query(WITH + ", p AS (SELECT lower(extra.provider) AS provider, unnest(coalesce(extra.categories_src, [])) AS category FROM listed WHERE extra.provider IS NOT NULL) SELECT provider, count(*) AS n, mode_category FROM (SELECT provider, category, first_value(category) OVER (PARTITION BY provider ORDER BY c DESC, category) AS mode_category FROM (SELECT *, count(*) OVER (PARTITION BY provider, category) AS c FROM p)) GROUP BY 1, 3")
def provider_groups(spark, d) -> DataFrame:
    r = current_apis(spark, d, "extra").where("extra.provider is not null").select(F.lower("extra.provider").alias("provider"), F.explode(F.coalesce("extra.categories_src", F.array().cast("array<string>"))).alias("category"))
    n = r.groupBy("provider", "category").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("provider").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("m"), "category"))["category"].alias("mode_category"))
