"""Queries over the event log, read as a request log: classification, sessions, reports, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, scoring, text
from ..operators import sessions
from .common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Events carry no headers; these, chosen by user and event, make a request log of them.
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (Macintosh) Version/17.0 Safari/605.1", "Mozilla/5.0; compatible; GPTBot/1.1", "python-requests/2.31", "", "ChatGPT-User/1.0",
    "Mozilla/5.0 (compatible; bingbot/2.0)", "curl/8.4.0", "SomethingElse/1.0", "Claude-User/1.0", "Mozilla/5.0 (compatible; AhrefsBot/7.0)",
]
NETWORKS = [(16509, "AMAZON-02"), (7922, "Comcast Cable"), (8075, "MICROSOFT-CORP"), (3320, "Deutsche Telekom"), (64500, "Example University"), (13335, "CLOUDFLARENET"), (15169, "GOOGLE")]
PATHS = {"view": "/skills/page-", "click": "/_astro/app.", "error": "/backup.sql?", "signup": "/api/v1/search?", "purchase": "/docs/readme.md?"}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_LOG = f"""log AS (SELECT event_id, ts, 'h' || user_id % 40 AS ip_hash, ({_LIST(AGENTS)})[1 + user_id % {len(AGENTS)}] AS user_agent, ({[n[0] for n in NETWORKS]})[1 + (user_id // 3) % {len(NETWORKS)}]::BIGINT AS asn, ({_LIST([n[1] for n in NETWORKS])})[1 + (user_id // 3) % {len(NETWORKS)}] AS org,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PATHS.items())} END || event_id % 7 AS path, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, CASE WHEN user_id % 13 = 0 THEN 'text/html;q=0.8, text/markdown' ELSE 'text/html,*/*;q=0.5' END AS accept,
  CASE WHEN event_id % 2 = 0 THEN 'navigate' ELSE '' END AS fetch_mode, CASE WHEN user_id % 50 = 7 THEN 'tok; tool=Robo' ELSE NULL END AS token, user_id % 31 = 3 AS mcp_valid, CASE WHEN user_id % 4 = 0 THEN 'verified' ELSE 'absent' END AS signature, event_type, value FROM events)"""


def request_log(spark, d) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + i).cast("int"))
    user, event = F.col("user_id"), F.col("event_id")
    net = F.floor(user / 3) % len(NETWORKS)
    return table(spark, d, "events").select(
        "event_id", "ts", F.concat(F.lit("h"), user % 40).alias("ip_hash"), pick(AGENTS, user % len(AGENTS)).alias("user_agent"), pick([n[0] for n in NETWORKS], net).cast("long").alias("asn"), pick([n[1] for n in NETWORKS], net).alias("org"),
        F.concat(F.element_at(text.literal_map(PATHS), F.col("event_type")), event % 7).alias("path"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
        F.when(user % 13 == 0, "text/html;q=0.8, text/markdown").otherwise("text/html,*/*;q=0.5").alias("accept"), F.when(event % 2 == 0, "navigate").otherwise("").alias("fetch_mode"),
        F.when(user % 50 == 7, "tok; tool=Robo").alias("token"), (user % 31 == 3).alias("mcp_valid"), F.when(user % 4 == 0, "verified").otherwise("absent").alias("signature"), "event_type", "value",
    )


_H, _R = classify.HOSTING_NAMES, classify.RESIDENTIAL_NAMES
_DECL = lambda xs: " ".join(f"WHEN contains(ua, '{t}') THEN '{o}'" for t, o in xs)
_NET = "CASE op " + " ".join(f"WHEN '{o}' THEN regexp_matches(coalesce(org, ''), '(?i){p}')" for o, p in classify.OPERATOR_NETWORKS.items()) + " END"
_AUTO = "|".join(a.replace("-", "[-]") for a in classify.AUTOMATION)
_CLASSED = f"""u AS (SELECT *, lower(coalesce(user_agent, '')) AS ua, CASE WHEN asn IN ({', '.join(map(str, classify.HOSTING_ASNS))}) OR regexp_matches(org, '{_H}') THEN 'hosting' WHEN regexp_matches(org, '{_R}') THEN 'isp_residential' ELSE 'unknown' END AS asn_class,
    CASE WHEN fetch_mode <> '' THEN 1 WHEN try_cast(regexp_extract(user_agent, '(?i)chrome/(\\d+)', 1) AS INT) >= 80 THEN 0 END AS coherent FROM log),
  v AS (SELECT *, CASE {_DECL(classify.AGENTS)} WHEN starts_with(ua, '{classify.AGENT_PREFIXES[0][0]}') THEN '{classify.AGENT_PREFIXES[0][1]}' END AS agent, CASE {_DECL(classify.CRAWLERS)} END AS crawler FROM u),
  w AS (SELECT *, coalesce(agent, crawler) AS op FROM v),
  x AS (SELECT *, signature <> 'verified' AND asn_class = 'hosting' AND coalesce(NOT ({_NET}), false) AS false_name FROM w),
  c AS (SELECT *, CASE WHEN trim(coalesce(token, '')) <> '' THEN 'agent' WHEN mcp_valid THEN 'agent' WHEN op IS NOT NULL AND false_name THEN 'impersonation_suspected' WHEN agent IS NOT NULL THEN 'agent' WHEN crawler IS NOT NULL THEN 'crawler'
      WHEN regexp_matches(ua, '{_AUTO}') THEN 'automated_unknown' WHEN trim(ua) = '' THEN 'automated_unknown' WHEN starts_with(ua, 'mozilla/') AND asn_class = 'hosting' THEN 'automated_unknown' WHEN starts_with(ua, 'mozilla/') AND coherent = 0 THEN 'automated_unknown'
      WHEN starts_with(ua, 'mozilla/') AND coherent = 1 THEN 'human' ELSE 'unknown' END AS class,
    CASE WHEN trim(coalesce(token, '')) <> '' THEN 'token_echo' WHEN mcp_valid THEN 'mcp' WHEN op IS NOT NULL AND false_name THEN 'ua_asn_mismatch' WHEN op IS NOT NULL THEN 'ua_list' WHEN regexp_matches(ua, '{_AUTO}') THEN 'ua_list' WHEN trim(ua) = '' THEN 'no_ua'
      WHEN starts_with(ua, 'mozilla/') AND asn_class = 'hosting' THEN 'coherent_datacenter' WHEN starts_with(ua, 'mozilla/') AND coherent IS NOT NULL THEN 'coherence' ELSE 'default' END AS method,
    CASE WHEN trim(coalesce(token, '')) <> '' THEN nullif(lower(trim(regexp_extract(token, '(?i);\\s*tool=([^;]+)', 1))), '') WHEN mcp_valid THEN NULL ELSE op END AS operator FROM x)"""
WITH = f"WITH {_LOG}, {_CLASSED}"


def classified(spark, d) -> DataFrame:
    return with_class(request_log(spark, d))


def with_class(r: DataFrame) -> DataFrame:
    """A request log, stored or streamed, with the class of each request."""
    c = F.col
    r = r.withColumn("asn_class", classify.network_class(c("asn"), c("org"))).withColumn("coherent", classify.fetch_coherence(c("user_agent"), c("fetch_mode")))
    verdict = classify.request_class(c("user_agent"), c("token"), c("mcp_valid"), F.lit(None).cast("string"), c("asn"), c("org"), c("coherent"), c("signature"))
    r = r.withColumn("_v", verdict)
    return r.select("*", "_v.class", "_v.operator", "_v.confidence", "_v.method").drop("_v")


@query(WITH + " SELECT event_id, class, operator, method, asn_class FROM c")
def classify_requests(spark, d) -> DataFrame:
    return classified(spark, d).select("event_id", "class", "operator", "method", "asn_class")


_ANY = lambda xs: "(" + " OR ".join(f"path ILIKE '{x}'" for x in xs) + ")"
_SESS = WITH + f""", s AS (SELECT ts::DATE::VARCHAR AS day, ip_hash, user_agent, count(*) AS total, count(DISTINCT path) AS paths, count(*) FILTER ({_ANY(classify.ASSET_PATHS)}) AS assets, count(*) FILTER (NOT {_ANY(classify.ASSET_PATHS)}) AS content, count(*) FILTER (accept ILIKE '%text/markdown%') AS markdown,
  count(*) FILTER ({_ANY(classify.ENDPOINT_PATHS)}) AS endpoint, count(*) FILTER (coherent = 0) AS incoherent, count(*) FILTER (method = 'token_echo') AS token, count(*) FILTER (method = 'mcp') AS mcp, max(class) AS class, max(asn_class) AS asn_class FROM c GROUP BY 1, 2, 3),
  r AS (SELECT *, CASE WHEN assets + content > 0 THEN assets / (assets + content) ELSE 0 END AS ratio, token > 0 OR mcp > 0 AS coop FROM s),
  z AS (SELECT *, CASE WHEN coop THEN 1.0::DOUBLE ELSE round(greatest(0, least(1, 0.3::DOUBLE + CASE WHEN markdown > 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN endpoint > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN ratio < 0.1 AND content >= 1 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN incoherent > 0 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN paths >= 3 AND total <= paths + 1 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN ratio >= 0.5 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN incoherent = 0 AND total >= 3 AND ratio > 0 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN asn_class = 'isp_residential' THEN 0.2::DOUBLE ELSE 0 END)), 6) END AS score FROM r),
  b AS (SELECT *, CASE WHEN score >= 0.6 AND NOT (total = 1 AND markdown = 0 AND endpoint = 0 AND NOT coop) THEN 'agent-shaped' WHEN score >= 0.3 THEN 'uncertain' ELSE 'human-shaped' END AS band FROM z),
  y AS (SELECT *, total = 1 AND assets = 0 AND content >= 1 AND band <> 'agent-shaped' AND NOT coop AS single_fetch FROM b)"""


@query(_SESS + " SELECT day, ip_hash, user_agent, total, paths, assets, content, markdown, endpoint, incoherent, token, mcp, class, asn_class FROM s")
def session_aggregates(spark, d) -> DataFrame:
    return sessions.sessions(classified(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(_SESS + " SELECT day, ip_hash, user_agent, score, band, single_fetch FROM y")
def session_bands(spark, d) -> DataFrame:
    s = sessions.scored(sessions.sessions(classified(spark, d)))
    return s.select(F.col("day").cast("string").alias("day"), "ip_hash", "user_agent", "score", "band", "single_fetch")


@query(
    _SESS + ", a AS (SELECT count(*) AS sessions, count(*) FILTER (class IN ('human', 'unknown')) AS pool, count(*) FILTER (class IN ('human', 'unknown') AND band = 'agent-shaped') AS agent_shaped, count(*) FILTER (class IN ('human', 'unknown') AND band = 'uncertain') AS uncertain, count(*) FILTER (class IN ('human', 'unknown') AND band = 'human-shaped') AS human_shaped, "
    "count(*) FILTER (class IN ('human', 'unknown') AND markdown > 0) AS with_markdown, count(*) FILTER (class IN ('human', 'unknown') AND endpoint > 0) AS with_endpoint, count(*) FILTER (class IN ('human', 'unknown') AND incoherent > 0) AS with_incoherent, count(*) FILTER (class IN ('human', 'unknown') AND single_fetch) AS single_fetch, "
    "count(*) FILTER (ratio >= 0.5 AND incoherent = 0 AND asn_class = 'isp_residential') AS clearly_human, count(*) FILTER (coop) AS cooperative FROM y) SELECT *, CASE WHEN pool > 0 THEN floor(agent_shaped * 100.0::DOUBLE / pool * 10 + 0.5) / 10.0 ELSE 0 END::DOUBLE AS pct_agent_shaped, agent_shaped AS range_low, (agent_shaped + floor(uncertain / 2.0 + 0.5))::BIGINT AS range_high FROM a"
)
def agent_report(spark, d) -> DataFrame:
    return sessions.band_report(sessions.scored(sessions.sessions(classified(spark, d))))


@query(WITH + " SELECT ts::DATE::VARCHAR AS day, count(*) AS total, count(*) FILTER (class = 'agent') AS agent, count(*) FILTER (class = 'crawler') AS crawler, count(*) FILTER (class = 'human') AS human, count(*) FILTER (class = 'automated_unknown') AS automated_unknown, count(*) FILTER (class = 'unknown') AS \"unknown\", count(*) FILTER (class = 'impersonation_suspected') AS impersonation_suspected, count(*) FILTER (method = 'coherent_datacenter') AS coherent_datacenter, count(*) FILTER (signature = 'verified') AS verified, count(*) FILTER (status = 404 AND " + _ANY(classify.PROBE_PATHS) + ") AS probes FROM c GROUP BY 1")
def daily_pivot(spark, d) -> DataFrame:
    c = classified(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    classes = ["agent", "crawler", "human", "automated_unknown", "unknown", "impersonation_suspected"]
    return c.groupBy("day").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("class") == k).alias(k) for k in classes], F.count_if(F.col("method") == "coherent_datacenter").alias("coherent_datacenter"), F.count_if(F.col("signature") == "verified").alias("verified"), F.count_if((F.col("status") == 404) & classify.path_like(F.col("path"), classify.PROBE_PATHS)).alias("probes"))


@query(WITH + " SELECT operator, day, n FROM (SELECT operator, ts::DATE::VARCHAR AS day, count(*) AS n FROM c WHERE class = 'impersonation_suspected' GROUP BY 1, 2)")
def impersonation_by_operator(spark, d) -> DataFrame:
    return classified(spark, d).where("class = 'impersonation_suspected'").groupBy("operator", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG}, n AS (SELECT event_id, row_number() OVER (PARTITION BY ip_hash, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS p FROM log) SELECT event_id FROM n WHERE p > 1")
def rate_limited(spark, d) -> DataFrame:
    return sessions.over_limit(request_log(spark, d), ["ip_hash"], "ts", 3600, 1, [F.asc("ts"), F.asc("event_id")]).select("event_id")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM s GROUP BY user_id, s")
def gap_sessions(spark, d) -> DataFrame:
    s = sessions.gap_sessions(table(spark, d, "events"), "user_id", "ts", "4 hours")
    return s.select("user_id", F.unix_micros("start").alias("started_us"), "n")


@query("WITH e AS (SELECT event_type, ts::DATE AS day FROM events), w AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-06', INTERVAL 1 DAY))::DATE AS finish) SELECT finish::VARCHAR AS finish, event_type, count(*) AS n FROM w JOIN e ON e.day > finish - 7 AND e.day <= finish GROUP BY 1, 2")
def sliding_week(spark, d) -> DataFrame:
    # Daily counts first: seven rows per day and type enter the windows, however many events there are.
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    w = e.select("event_type", "c", F.explode(F.sequence("day", F.date_add("day", 6))).alias("finish"))
    return w.groupBy(F.col("finish").cast("string").alias("finish"), "event_type").agg(F.sum("c").alias("n"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' AND event_type = 'signup' ORDER BY ts, event_id LIMIT 100")
def since_cursor(spark, d) -> DataFrame:
    e = table(spark, d, "events").where((F.col("ts") > F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")) & (F.col("event_type") == "signup"))
    return e.orderBy("ts", "event_id").limit(100).select("event_id")


_B = "b AS (SELECT user_id, ts::DATE AS day, count(*) AS interactions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS moves, bool_or(event_type = 'purchase') AS wheel, max(event_id % 7)::DOUBLE AS spread, (count(*) FILTER (event_type = 'error')) / count(*) AS teleport, (count(*) FILTER (event_type = 'view'))::DOUBLE AS rate FROM events GROUP BY 1, 2)"


@query(f"WITH {_B.replace('ts::DATE', chr(39) + 'all' + chr(39))}, s AS (SELECT *, round(greatest(0, least(1, CASE WHEN clicks > 0 THEN greatest(0, least(1, (5 - rate) / 5)) ELSE 0 END * 0.3::DOUBLE + CASE WHEN interactions >= 12 AND NOT wheel THEN 1 ELSE 0 END * 0.2::DOUBLE + CASE WHEN clicks > 0 THEN greatest(0, least(1, teleport)) ELSE 0 END * 0.25::DOUBLE + CASE WHEN interactions >= 12 THEN greatest(0, least(1, (20 - moves) / 20)) ELSE 0 END * 0.15::DOUBLE + CASE WHEN clicks >= 2 THEN greatest(0, least(1, (10 - spread) / 10)) ELSE 0 END * 0.1::DOUBLE)), 6) AS score FROM b) SELECT user_id, score, CASE WHEN interactions < 12 THEN 'uncertain' WHEN score >= 0.6 THEN 'automation-signature' WHEN score <= 0.4 THEN 'human-shaped' ELSE 'uncertain' END AS band FROM s")
def behaviour_scores(spark, d) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    b = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("interactions"), of("click").alias("clicks"), of("view").alias("moves"), F.bool_or(F.col("event_type") == "purchase").alias("wheel"), F.max(F.col("event_id") % 7).cast("double").alias("spread"), (of("error") / F.count(F.lit(1))).alias("teleport"), of("view").cast("double").alias("rate"))
    s = scoring.behaviour_score(F.col("rate"), F.col("wheel"), F.col("teleport"), F.col("clicks"), F.col("moves"), F.col("spread"), F.col("interactions"))
    return b.select("user_id", s.alias("s")).select("user_id", "s.score", "s.band")


@query(f"WITH {_LOG} SELECT accept, CASE WHEN contains(accept, 'markdown') THEN true ELSE false END AS markdown, count(*) AS n, left(sha256('2024-01-01' || ip_hash), 16) AS daily_key FROM log GROUP BY 1, 2, 4")
def accept_negotiation(spark, d) -> DataFrame:
    key = F.substring(F.sha2(F.concat(F.lit("2024-01-01"), "ip_hash"), 256), 1, 16)
    return request_log(spark, d).groupBy("accept", text.prefers_markdown(F.col("accept")).alias("markdown"), key.alias("daily_key")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 403 WHEN 'purchase' THEN 402 WHEN 'signup' THEN 503 ELSE 200 END AS status, CASE WHEN event_id % 3 = 0 THEN 'Just a moment...' ELSE 'hello' END AS body, floor(value * 100)::BIGINT AS bytes FROM events), a AS (SELECT *, CASE WHEN status = 402 THEN 'toll' WHEN status IN (403, 503) AND event_id % 3 = 0 THEN 'challenged' WHEN status = 403 THEN 'blocked' WHEN status = 200 THEN 'allowed' ELSE 'error' END AS answer FROM p) SELECT user_id % 5 AS tier, count(*) AS probes, count(*) FILTER (answer = 'challenged') AS challenged, count(*) FILTER (answer = 'blocked') AS blocked, count(*) FILTER (answer = 'toll') AS toll, count(*) FILTER (answer = 'allowed') AS allowed, count(*) FILTER (answer = 'error') AS error, min(bytes) AS min_bytes, median(bytes)::DOUBLE AS median_bytes, max(bytes) AS max_bytes, floor(count(*) FILTER (answer = 'allowed') * 1.0::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS allowed_rate FROM a GROUP BY 1")
def probe_report(spark, d) -> DataFrame:
    e = F.col("event_type")
    p = table(spark, d, "events").select((F.col("user_id") % 5).alias("tier"), F.when(e == "error", 403).when(e == "purchase", 402).when(e == "signup", 503).otherwise(200).alias("status"), F.when(F.col("event_id") % 3 == 0, "Just a moment...").otherwise("hello").alias("body"), F.floor(F.col("value") * 100).alias("bytes"))
    p = p.withColumn("answer", classify.answer_class(F.col("status"), F.lit(None).cast("string"), F.col("body"), F.lit(False)))
    of = lambda k: F.count_if(F.col("answer") == k).alias(k)
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("probes"), of("challenged"), of("blocked"), of("toll"), of("allowed"), of("error"), F.min("bytes").alias("min_bytes"), F.percentile("bytes", 0.5).alias("median_bytes"), F.max("bytes").alias("max_bytes"), (F.floor(F.count_if(F.col("answer") == "allowed") / F.count(F.lit(1)) * 1000 + 0.5) / 1000).alias("allowed_rate"))


@query("WITH h AS (SELECT event_type, ts::DATE AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.day::VARCHAR AS day, a.event_type AS kind, abs(a.n - b.n) > 0.3 * greatest(a.n, b.n) AS differs FROM h a JOIN h b ON a.day = b.day AND a.event_type < b.event_type AND b.event_type = 'view'")
def differing_answers(spark, d) -> DataFrame:
    h = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    b = h.where("event_type = 'view'").select("day", F.col("n").alias("m"))
    r = h.where("event_type < 'view'").join(b, "day")
    return r.select(F.col("day").cast("string").alias("day"), F.col("event_type").alias("kind"), classify.differs_by_agent(F.lit(200), F.lit(200), F.col("n"), F.col("m")).alias("differs"))
