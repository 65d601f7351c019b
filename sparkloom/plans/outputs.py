"""Queries over sinks, streams and the packs of single record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import access, classify, entities, rules, scoring, text
from ..operators import reports, vectors
from ..runtime import merged, scratch, written
from ..sources import documents, sinks
from ..streaming import jobs
from . import traffic
from .common import CURRENT_SQL, LISTED_SQL, current_apis, current_skills, table
from .nearest import _MODAL, _REASON

QUERIES, ORACLES = {}, {}
CUR, LISTED = "WITH " + CURRENT_SQL, "WITH " + LISTED_SQL


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(CUR + " SELECT to_json({'catalog': 'skills', 'total': count(*), 'scored': count(quality_score), 'best': max(quality_score), 'license': NULL})::VARCHAR AS document FROM cur")
def report_document(spark, d) -> DataFrame:
    """One report as one JSON document; what is unknown is null, not absent."""
    row = current_skills(spark, d, "quality_score").agg(F.count(F.lit(1)).alias("n"), F.count("quality_score").alias("scored"), F.max("quality_score").alias("best"))
    return sinks.document(row, catalog=F.lit("skills"), total=F.col("n"), scored=F.col("scored"), best=F.col("best"), license=F.lit(None).cast("string"))


@query(CUR + ", t AS (SELECT id, name, quality_score FROM cur WHERE quality_tier IN ('featured', 'solid')) SELECT to_json({'count': count(*), 'records': coalesce(list({'id': id, 'quality_score': quality_score} ORDER BY quality_score DESC, id), [])})::VARCHAR AS document FROM t WHERE quality_score IS NOT NULL")
def registry_document(spark, d) -> DataFrame:
    """The records of the upper tiers as one document; its size is bounded by the sink's limit, as its readers want it."""
    r = current_skills(spark, d, "quality_tier", "quality_score").where("quality_score is not null")
    return sinks.registry(r, ["featured", "solid"], "quality_tier", ["id", "quality_score"], [F.desc("quality_score"), F.col("id")])


@query(f"WITH {_MODAL} SELECT DISTINCT id FROM (SELECT id, {_REASON} AS reason FROM skill_vectors, modal) WHERE reason IS NOT NULL AND id IS NOT NULL")
def refused_vectors(spark, d) -> DataFrame:
    """Vectors sent in batches to a service that refuses a batch with an unusable one; halving finds exactly those."""
    v = table(spark, d, "skill_vectors").where("id is not null").select("id", "values")
    size = vectors.modal_size(v, "values").select("size").scalar()
    rows = v.withColumn("size", size).select("id", vectors.invalid_reason(F.col("values"), F.col("size")).isNull().alias("usable"))

    def send(batch: list[dict]) -> None:
        if not all(r["usable"] for r in batch):
            raise ValueError("a vector of the batch cannot be used")

    return sinks.deliver(rows, send, key="id").select(F.col("row").alias("id")).distinct()


#: Records that one run may publish.
BUDGET = 200
_VALUE = "coalesce(name, '') || '|' || coalesce(quality_tier, '')"
_OLDER = "older AS (SELECT * FROM skills WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at NULLS FIRST, row_id) = 1)"


@query(CUR + ", " + _OLDER + f", p AS (SELECT id, {_VALUE} AS value FROM older WHERE repo_archived), c AS (SELECT id, {_VALUE} AS value, quality_score FROM cur) SELECT c.id, sha256(c.value) AS sha FROM c LEFT JOIN p USING (id) WHERE p.value IS NULL OR p.value <> c.value ORDER BY coalesce(quality_score, -1) DESC, c.id LIMIT {BUDGET}")
def published_budget(spark, d) -> DataFrame:
    """The best of what is new or changed since the last publication, as many as one run may write."""
    value = F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("quality_tier", F.lit("")))
    rows = current_skills(spark, d, "name", "quality_tier", "quality_score")
    raw = table(spark, d, "skills").where("id is not null").groupBy("id").agg(F.min_by(F.struct("name", "quality_tier", "repo_archived"), F.struct("scraped_at", "row_id")).alias("o")).select("id", "o.*").where("repo_archived")
    todo, _ = sinks.publish(rows, raw.select(F.col("id").alias("key"), F.sha2(value, 256).alias("sha")), "id", value, [-F.coalesce("quality_score", F.lit(-1))], BUDGET)
    return todo.select(F.col("key").alias("id"), "sha")


@query(CUR + " SELECT p.id AS plugin, m.id AS server FROM cur p JOIN cur m ON p.repo_full_name = m.repo_full_name AND p.entity_type = 'plugin' AND m.entity_type = 'mcp_server'")
def repository_servers(spark, d) -> DataFrame:
    """Plugins and servers of the same repository, wherever in it they lie."""
    r = current_skills(spark, d, "entity_type", "repo_full_name").where("repo_full_name is not null")
    of = lambda kind, name: r.where(F.col("entity_type") == kind).select("repo_full_name", F.col("id").alias(name))
    return merged(of("plugin", "plugin"), of("mcp_server", "server"), "repo_full_name").select("plugin", "server")


@query(traffic.WITH + " SELECT class, count(*) AS n FROM c GROUP BY 1")
def stream_classes(spark, d) -> DataFrame:
    """Requests classified as they arrive and appended to a table, in several runs from one checkpoint."""
    log = written(traffic.request_log(spark, d).repartition(4), "log")
    path, out, mark = log.inputFiles()[0].rsplit("/", 1)[0], scratch(spark, "classes"), scratch(spark, "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        stream = traffic.with_class(jobs.read_log(spark, path, log.schema, files_per_batch=2)).select("event_id", "class")
        jobs.run_available(stream, out, mark).awaitTermination()
    return spark.read.schema("event_id long, class string").parquet(out).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(CUR + " SELECT id, row_id FROM cur")
def stream_upsert(spark, d) -> DataFrame:
    """Deliveries merged batch by batch into a table of current rows; a batch that comes twice changes nothing."""
    rows = written(table(spark, d, "skills").where("id is not null").select("id", "row_id", "scraped_at").repartition(3, "row_id"), "deliveries")
    path, mark, states = rows.inputFiles()[0].rsplit("/", 1)[0], scratch(spark, "checkpoint"), []

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        both = sinks.upsert(session.read.schema(rows.schema).parquet(states[-1]), batch, ["id"], [F.col("scraped_at"), F.col("row_id")]) if states else sinks.upsert(batch, batch, ["id"], [F.col("scraped_at"), F.col("row_id")])
        path = scratch(session, f"state{number}")
        both.write.parquet(path)
        states.append(path)

    jobs.merge_available(jobs.read_log(spark, path, rows.schema, files_per_batch=1), merge, mark).awaitTermination()
    last = spark.read.schema(rows.schema).parquet(states[-1]) if states else rows
    return last.select("id", "row_id")


_STATED = "length(trim(coalesce(description, '')))"


def _reasons(gates: list[tuple[str, Column]]) -> Column:
    return F.coalesce(rules.first_reason(gates), F.lit("kept"))


@query(CUR + f", p AS (SELECT CASE WHEN {_STATED} < 50 THEN 'short_description' WHEN category IS NULL AND coalesce(len(tags), 0) < 1 THEN 'no_manifest' WHEN coalesce(len(tags), 0) < 1 THEN 'no_components' ELSE 'kept' END AS reason FROM cur WHERE entity_type = 'plugin') SELECT reason, count(*) AS n FROM p GROUP BY 1")
def plugin_gate_counts(spark, d) -> DataFrame:
    """The category stands for the manifest, tags for listings and components."""
    r = current_skills(spark, d, "entity_type", "description", "category", "tags").where("entity_type = 'plugin'")
    manifest = F.when(F.col("category").isNotNull(), F.create_map(F.lit("category"), F.col("category")))
    return r.groupBy(_reasons(entities.plugin_gates(F.col("description"), manifest, F.col("tags"), [F.col("tags")])).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(CUR + f", p AS (SELECT CASE WHEN {_STATED} < 50 THEN 'short_description' WHEN repo_license IS NULL THEN 'no_transport' WHEN coalesce(len(tags), 0) < 1 THEN 'no_tools' ELSE 'kept' END AS reason FROM cur WHERE entity_type = 'mcp_server') SELECT reason, count(*) AS n FROM p GROUP BY 1")
def server_gate_counts(spark, d) -> DataFrame:
    """The licence stands for the transport, tags for tools."""
    r = current_skills(spark, d, "entity_type", "description", "repo_license", "tags").where("entity_type = 'mcp_server'")
    return r.groupBy(_reasons(entities.server_gates(F.col("description"), F.col("repo_license"), F.col("tags"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(LISTED + f", p AS (SELECT CASE WHEN {_STATED} < 50 THEN 'short_description' WHEN trim(coalesce(home_url, '')) = '' THEN 'no_home' ELSE 'kept' END AS reason FROM listed) SELECT reason, count(*) AS n FROM p GROUP BY 1")
def dataset_gate_counts(spark, d) -> DataFrame:
    r = current_apis(spark, d, "description", "home_url")
    return r.groupBy(_reasons(entities.dataset_gates(F.col("description"), F.col("home_url"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(CUR + ", names AS (SELECT repo_full_name AS repo FROM cur WHERE repo_full_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) SELECT id, coalesce(repo_full_name IN (SELECT repo FROM names), false) AS denied FROM cur")
def denied_repositories(spark, d) -> DataFrame:
    """Exact, case-sensitive membership of a list of six repositories (here the largest)."""
    r = current_skills(spark, d, "repo_full_name")
    names = r.where("repo_full_name is not null").groupBy("repo_full_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo_full_name").limit(6)
    return r.select("id", entities.listed(F.col("repo_full_name"), [x[0] for x in names.collect()]).alias("denied"))  # six rows


_COUNTRIES = ["FR", "US", "NO", "GB", "CH", "DE", "fr", "LI"]


@query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN false ELSE ([{', '.join(repr(c) for c in _COUNTRIES)}])[1 + user_id % {len(_COUNTRIES)}] IN ({', '.join(repr(c) for c in entities.EEA)}) END AS inside FROM events")
def eea_requests(spark, d) -> DataFrame:
    """Requests from the EU, the EEA and the United Kingdom; errors come without a country."""
    country = F.when(F.col("event_type") != "error", F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), (F.col("user_id") % len(_COUNTRIES) + 1).cast("int")))
    return table(spark, d, "events").select("event_id", entities.in_eea(country).alias("inside"))


_S = {"stars": "coalesce(repo_stars, 0) % 101", "license": "CASE WHEN repo_license IS NULL THEN 0 ELSE 100 END", "description": f"least(100, {_STATED})"}


@query(CUR + ", s AS (SELECT id, entity_type, " + ", ".join(f"{v} AS {k}" for k, v in _S.items()) + ", coalesce(quality_score, 0) AS q FROM cur) SELECT id, CASE WHEN entity_type = 'skill' THEN floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.2::DOUBLE * stars + 0.1::DOUBLE * license + 0.05::DOUBLE * description)) + 0.5)::BIGINT WHEN entity_type = 'plugin' THEN floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.2::DOUBLE * q + 0.1::DOUBLE * license)) + 0.5)::BIGINT ELSE 0 END AS total FROM s")
def type_scores(spark, d) -> DataFrame:
    """The total of a record by the signals of its type; types without signals score 0."""
    r = current_skills(spark, d, "entity_type", "repo_stars", "repo_license", "description", "quality_score")
    zero = F.lit(0)
    none = dict.fromkeys(scoring.RECORD_WEIGHTS, zero)
    license_ = F.when(F.col("repo_license").isNull(), 0).otherwise(100)
    skill = {**none, "stars": F.coalesce("repo_stars", zero) % 101, "license": license_, "description": F.least(F.lit(100), F.length(F.trim(F.coalesce("description", F.lit("")))))}
    plugin = {**none, "stars": F.coalesce("quality_score", zero), "license": license_}
    return r.select("id", entities.total_score(F.col("entity_type"), {"skill": skill, "plugin": plugin}).alias("total"))


_BOTS = ["GPTBot", "CCBot", "OtherBot"]
_R = "r AS (SELECT id, coalesce(access.auth.type, 'none') AS auth, coalesce(access.cost.model, 'free') AS cost, coalesce(extra.endpoint_count, 0) % 4 AS kind FROM listed)"


def _robots(spark, d) -> DataFrame:
    """(id, auth, cost, kind, status, text): a robots file for each listing; auth shuts out one agent, cost all of them, two agents share a group."""
    r = current_apis(spark, d, "access", "extra").select("id", F.coalesce("access.auth.type", F.lit("none")).alias("auth"), F.coalesce("access.cost.model", F.lit("free")).alias("cost"), (F.coalesce("extra.endpoint_count", F.lit(0)) % 4).alias("kind"))
    own = F.when(F.col("auth") == "oauth2", "User-agent: gptbot\nUser-Agent: OtherBot # both\nDisallow: /\nAllow: /open$\n\n").when(F.col("auth") == "bearer", "User-agent: CCBot\nDisallow: /private*/x\nnonsense\n\n").otherwise("")
    rest = F.when(F.col("cost") == "paid", "User-agent: *\nDisallow: /\nSitemap: s\n").otherwise("User-agent: *\nDisallow:\nContent-Signal: ai=no\n")
    status = F.when(F.col("kind") == 2, 404).when(F.col("kind") == 3, 503).otherwise(200)
    return r.select("*", status.alias("status"), F.concat(own, rest).alias("text"))


@query(LISTED + f", {_R} SELECT id, CASE kind WHEN 2 THEN 'allow_all' WHEN 3 THEN 'disallow_all' ELSE 'parsed' END AS policy, CASE WHEN kind >= 2 THEN [] WHEN auth = 'oauth2' THEN ['GPTBot', 'OtherBot'] WHEN auth = 'bearer' THEN ['CCBot'] ELSE [] END AS named, CASE WHEN kind < 2 AND auth = 'oauth2' THEN ['GPTBot', 'OtherBot'] ELSE [] END AS shut_out, kind = 3 OR (kind < 2 AND cost = 'paid') AS shuts_out_all FROM r")
def robots_flags(spark, d) -> DataFrame:
    """Which agents the robots file of each listing names and shuts out; a missing file allows all, a failing site nothing."""
    p = documents.robots_policy(_BOTS)(F.col("status"), F.col("text"))
    return _robots(spark, d).select("id", p.alias("p")).select("id", "p.policy", "p.named", "p.shut_out", "p.shuts_out_all")


_PATHS = ["/", "/open", "/open/a", "/private1/x", "/private/y", "/a"]


@query(LISTED + f", {_R}, p AS (SELECT id, auth, cost, unnest([{', '.join(repr(x) for x in _PATHS)}]) AS path FROM r) SELECT id, path, CASE WHEN auth = 'bearer' THEN NOT regexp_matches(path, '^/private.*/x') ELSE cost <> 'paid' END AS ccbot, CASE WHEN auth = 'oauth2' THEN path = '/open' ELSE cost <> 'paid' END AS gptbot FROM p")
def robots_paths(spark, d) -> DataFrame:
    """Whether two agents may fetch each of some paths: their own group, else the common one; the longest rule decides."""
    r = _robots(spark, d).select("id", "text", F.explode(F.array(*[F.lit(x) for x in _PATHS])).alias("path"))
    may = documents.may_fetch
    return r.select("id", "path", may(F.col("text"), F.col("path"), F.lit("CCBot")).alias("ccbot"), may(F.col("text"), F.col("path"), F.lit("GPTBot")).alias("gptbot"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN false ELSE json_valid(props) END AS well_formed FROM events WHERE props IS NOT NULL")
def well_known_bodies(spark, d) -> DataFrame:
    """Bodies that are JSON; those of clicks are cut before their end."""
    e = table(spark, d, "events").where("props is not null")
    body = F.when(F.col("event_type") == "click", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return e.select("event_id", documents.well_formed(body).alias("well_formed"))


@query(CUR + " SELECT id, '# ' || coalesce(name, 'untitled') || chr(10) || chr(10) || CASE WHEN description IS NULL THEN '' ELSE description || chr(10) || chr(10) END || '- repository: ' || coalesce(repo_full_name, 'unknown') || chr(10) || '- score: ' || coalesce(quality_score::VARCHAR, '-') || chr(10) || CASE WHEN len(tags) > 0 THEN '- tags: ' || array_to_string(list_sort(tags), ', ') || chr(10) ELSE '' END AS page FROM cur")
def record_pages(spark, d) -> DataFrame:
    """Each record as a Markdown page."""
    r = current_skills(spark, d, "name", "description", "repo_full_name", "quality_score", "tags")
    return r.select("id", text.record_page(F.col("name"), F.col("description"), F.col("repo_full_name"), F.col("quality_score"), F.col("tags")).alias("page"))


@query(CUR + " SELECT '# Catalog' || chr(10) || string_agg('- ' || k || ': ' || n, chr(10) ORDER BY n DESC, k) AS page FROM (SELECT coalesce(entity_type, '-') AS k, count(*) AS n FROM cur GROUP BY 1)")
def index_page(spark, d) -> DataFrame:
    """The counts of the catalog as a text for language models: one line per type."""
    n = current_skills(spark, d, "entity_type").groupBy(F.coalesce("entity_type", F.lit("-")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k"))), lambda x: F.concat(F.lit("- "), x.k, F.lit(": "), (-x.m).cast("string")))
    return n.agg(F.concat(F.lit("# Catalog\n"), F.array_join(lines, "\n")).alias("page"))


@query("WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events), f AS (SELECT user_id, min(ts) AS fetched FROM events GROUP BY 1 UNION ALL SELECT d.user_id, d.after FROM f JOIN d ON d.user_id = f.user_id AND d.ts = f.fetched WHERE d.after IS NOT NULL) SELECT user_id, n AS fetches, total - n AS hits FROM (SELECT user_id, count(*) AS n FROM f GROUP BY 1) JOIN (SELECT user_id, count(*) AS total FROM events GROUP BY 1) USING (user_id)")
def cached_lookups(spark, d) -> DataFrame:
    """A cache of 24 hours per key: a request is a hit while the last fetch is younger, else it fetches anew."""
    from ..operators.sessions import cache_fetches

    e = table(spark, d, "events").select("user_id", "ts")
    return cache_fetches(e, "user_id", "ts", 24 * 3600)


_HAVE = [("category", "String"), ("quality_score", "string"), ("slug", "string")]
_NEED = [("category", "string"), ("quality_score", "number"), ("entity_type", "string"), ("language", "string")]
_PAIRS = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)


@query(f"WITH need(name, want) AS (VALUES {_PAIRS(_NEED)}), have(name, have) AS (VALUES {_PAIRS(_HAVE)}), b AS (SELECT name, lower(want) AS want, lower(have) AS have, count(*) OVER () AS total, most FROM need FULL JOIN have USING (name), (VALUES (5), (4)) m(most)), c AS (SELECT name, most, CASE WHEN want IS NULL THEN 'unplanned' WHEN have IS NULL THEN CASE WHEN total / 2 > most THEN 'over_capacity' ELSE 'create' END WHEN want <> have THEN 'type_conflict' ELSE 'keep' END AS change FROM b) SELECT name, most, change FROM c")
def index_changes(spark, d) -> DataFrame:
    """An index plan against what exists, where it fits and where it does not."""
    need, have = (spark.createDataFrame(rows, "name string, kind string") for rows in (_NEED, _HAVE))
    fits = reports.index_changes(need, have, 5).withColumn("most", F.lit(5))
    return fits.unionByName(reports.index_changes(need, have, 4).withColumn("most", F.lit(4))).select("name", "most", "change")


@query("SELECT event_id, event_id % 4 = 1 OR (event_id % 4 = 2 AND event_type NOT IN ('view', 'click') AND event_id % 3 <> 0) AS refused FROM events")
def refused_credentials(spark, d) -> DataFrame:
    """Answers that refuse the credentials, among limits and other errors."""
    e = table(spark, d, "events")
    status = F.element_at(F.array(F.lit(200), F.lit(401), F.lit(403), F.lit(500)), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.when(F.col("event_id") % 3 == 0, "Not here").otherwise('{"message": "Bad credentials"}')
    return e.select("event_id", access.refuses_credentials(status, F.when(F.col("event_type") == "view", "60"), F.when(F.col("event_type") == "click", 0).otherwise(9), body).alias("refused"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR user_id % 5 = 0 THEN 'fail' WHEN event_type = 'view' THEN 'ok' WHEN event_id % 40 - 5 <= 0 THEN 'fail' WHEN event_id % 40 - 5 < 14 THEN 'warn' ELSE 'ok' END AS level FROM events")
def credential_levels(spark, d) -> DataFrame:
    """Credentials that are missing, refused, expired, about to expire, or well."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", 401).when(F.col("user_id") % 5 != 0, 200)
    return e.select("event_id", access.credential_level(status, F.when(F.col("event_type") != "view", F.col("event_id") % 40 - 5)).alias("level"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'absent' WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'malformed' WHEN user_id % 3 = 0 THEN 'expired' WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 'not_yet' ELSE 'unverified' END AS state FROM events")
def signature_states(spark, d) -> DataFrame:
    """What the signature headers of requests tell without their keys."""
    e = table(spark, d, "events")
    created = F.when((F.col("user_id") % 3 == 1) & (F.col("event_id") % 2 == 0), 2000).otherwise(900)
    expires = F.when(F.col("user_id") % 3 == 0, 1000).otherwise(5000)
    key = F.when(F.col("event_id") % 7 == 0, "").otherwise(';keyid="k1"')
    inputs = F.when(F.col("event_type") != "view", F.concat(F.lit('sig1=("@authority");created='), created.cast("string"), F.lit(";expires="), expires.cast("string"), key, F.lit(';tag="web-bot-auth"')))
    signature = F.when(~F.col("event_type").isin("view", "error"), F.lit("sig1=:YWJj+/=:"))
    return e.select("event_id", classify.signature_state(inputs, signature, F.lit(1000)).alias("state"))
