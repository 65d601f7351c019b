"""Decision lists over request logs and probe answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of user agents and networks, in the order in which they decide.
AGENTS = [("chatgpt-user", "openai"), ("claude-user", "anthropic"), ("perplexity-user", "perplexity"), ("mistralai-user", "mistral")]
AGENT_PREFIXES = [("claude-code/", "anthropic-claude-code")]
CRAWLERS = [
    ("gptbot", "openai"), ("oai-searchbot", "openai"), ("claude-searchbot", "anthropic"), ("claudebot", "anthropic"), ("perplexitybot", "perplexity"), ("bytespider", "bytedance"),
    ("meta-externalagent", "meta"), ("amazonbot", "amazon"), ("applebot", "apple"), ("googlebot", "google"), ("google-extended", "google"), ("googleother", "google"), ("bingbot", "microsoft"),
    ("dataforseobot", "dataforseo"), ("semrushbot", "semrush"), ("ahrefsbot", "ahrefs"), ("petalbot", "huawei"),
]
AUTOMATION = ["python-requests", "python-httpx", "aiohttp", "axios", "node-fetch", "undici", "go-http-client", "okhttp", "scrapy", "curl", "wget", "headlesschrome"]
HOSTING_ASNS = [16509, 14618, 8075, 396982, 16276, 24940, 14061, 63949, 20473, 45102, 37963, 132203, 45090, 31898, 55990, 136907, 13335]
HOSTING_NAMES = r"(?i)aws|amazon|ec2|azure|microsoft|google[\s_-]?cloud|gcp|alibaba|aliyun|tencent|kingsoft|huawei|ovh|hetzner|digital[\s_-]?ocean|vultr|linode|akamai|cloudflare|oracle|scaleway|leaseweb|contabo|m247|choopa|seedbox|hosting|datacenter|data[\s_-]?center|colo|vps|dedicated|server"
RESIDENTIAL_NAMES = r"(?i)comcast|verizon|at&t|at\s?t|t-mobile|charter|spectrum|cox|centurylink|china[\s_-]?mobile|china[\s_-]?telecom|china[\s_-]?unicom|vodafone|orange|deutsche[\s_-]?telekom|telus|rogers|broadband|residential|telecom|communications|cable|dsl|fiber|fios"
OPERATOR_NETWORKS = {
    "openai": "microsoft|azure|openai", "anthropic": "google|amazon|aws|anthropic", "anthropic-claude-code": "google|amazon|aws|anthropic", "perplexity": "perplexity|amazon|aws",
    "mistral": "mistral|ovh|scaleway|azure|microsoft", "google": "google", "bytedance": "bytedance|byteplus", "meta": "meta|facebook", "amazon": "amazon|aws", "apple": "apple",
    "microsoft": "microsoft|azure", "huawei": "huawei",
}
CHALLENGE_TEXT = r"(?i)just a moment|checking your browser|cf-chl|captcha|challenge-platform|verify you are human|attention required"


def network_class(asn: Column, org: Column) -> Column:
    """hosting, isp_residential or unknown; a hosting number or name goes before a residential name."""
    name = F.coalesce(org, F.lit(""))
    return F.when(F.coalesce(asn.isin(HOSTING_ASNS), F.lit(False)) | name.rlike(HOSTING_NAMES), "hosting").when(name.rlike(RESIDENTIAL_NAMES), "isp_residential").otherwise("unknown")


def operator_network(operator: Column, org: Column) -> Column:
    """Whether ``org`` is a network that the operator is known to use; null where nothing is known of the operator."""
    out = None
    for name, pattern in OPERATOR_NETWORKS.items():
        hit = F.coalesce(org, F.lit("")).rlike("(?i)" + pattern)
        out = F.when(operator == name, hit) if out is None else out.when(operator == name, hit)
    return out


def fetch_coherence(user_agent: Column, *fetch_headers: Column) -> Column:
    """1 where a Sec-Fetch header came, 0 where a browser that always sends them sent none, else null."""
    sent = F.greatest(*[F.length(F.coalesce(h, F.lit(""))) for h in fetch_headers], F.lit(0)) > 0
    version = F.regexp_extract(F.coalesce(user_agent, F.lit("")), r"(?i)chrome/(\d+)", 1).try_cast("int")
    return F.when(sent, 1).when(version >= 80, 0)


def _first(ua: Column, entries: list[tuple[str, str]], prefixes: list[tuple[str, str]] = []) -> Column:
    out = None
    for token, operator in entries:
        out = F.when(F.contains(ua, F.lit(token)), operator) if out is None else out.when(F.contains(ua, F.lit(token)), operator)
    for token, operator in prefixes:
        out = out.when(F.startswith(ua, F.lit(token)), operator)
    return out


def request_class(user_agent: Column, token: Column, mcp_valid: Column, mcp_client: Column, asn: Column, org: Column, coherent: Column, signature: Column) -> Column:
    """struct(class, operator, confidence, method): the first rule that applies decides; nothing is human by default."""
    ua = F.lower(F.coalesce(user_agent, F.lit("")))
    agent, crawler = _first(ua, AGENTS, AGENT_PREFIXES), _first(ua, CRAWLERS)
    # Bound once per row: repeated in every rule, these would grow the generated code beyond its limit.
    facts = F.struct(
        ua.alias("ua"),
        agent.alias("agent"),
        crawler.alias("crawler"),
        (network_class(asn, org) == "hosting").alias("hosting"),
        F.coalesce(org, F.lit("")).alias("org"),
        F.trim(F.coalesce(token, F.lit(""))).alias("token"),
        F.coalesce(mcp_valid, F.lit(False)).alias("mcp"),
        F.nullif(F.lower(F.trim(mcp_client)), F.lit("")).alias("client"),
        coherent.alias("coherent"),
        F.coalesce(signature == "verified", F.lit(False)).alias("verified"),
    )
    tool = lambda t: F.nullif(F.lower(F.trim(F.regexp_extract(t, r"(?i);\s*tool=([^;]+)", 1))), F.lit(""))

    def say(kind, operator, confidence, method):
        return F.struct(F.lit(kind).alias("class"), (operator if operator is not None else F.lit(None)).cast("string").alias("operator"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    def verdict(x: Column) -> Column:
        declared = F.coalesce(x.agent, x.crawler)
        false_name = ~x.verified & x.hosting & F.coalesce(~operator_network(declared, x.org), F.lit(False))
        automated = x.ua.rlike("|".join(a.replace("-", "[-]") for a in AUTOMATION))
        browser = F.startswith(x.ua, F.lit("mozilla/"))
        return (
            F.when(x.token != "", say("agent", tool(x.token), 0.95, "token_echo"))
            .when(x.mcp, say("agent", x.client, 0.95, "mcp"))
            .when(declared.isNotNull() & false_name, say("impersonation_suspected", declared, 0.8, "ua_asn_mismatch"))
            .when(x.agent.isNotNull(), say("agent", x.agent, 0.9, "ua_list"))
            .when(x.crawler.isNotNull(), say("crawler", x.crawler, 0.9, "ua_list"))
            .when(automated, say("automated_unknown", None, 0.8, "ua_list"))
            .when(F.trim(x.ua) == "", say("automated_unknown", None, 0.7, "no_ua"))
            .when(browser & x.hosting, say("automated_unknown", None, 0.7, "coherent_datacenter"))
            .when(browser & (x.coherent == 0), say("automated_unknown", None, 0.6, "coherence"))
            .when(browser & (x.coherent == 1), say("human", None, 0.7, "coherence"))
            .when(browser, say("unknown", None, 0.5, "default"))
            .otherwise(say("unknown", None, 0.3, "default"))
        )

    return F.element_at(F.transform(F.array(facts), verdict), 1)


def answer_class(status: Column, mitigated: Column, body: Column, failed: Column) -> Column:
    """toll, challenged, blocked, allowed or error for the answer to a probe."""
    challenge = F.lower(F.coalesce(mitigated, F.lit(""))) == "challenge"
    asked = status.isin(403, 503) & F.coalesce(body, F.lit("")).rlike(CHALLENGE_TEXT)
    return F.when(F.coalesce(failed, F.lit(False)) | status.isNull(), "error").when(status == 402, "toll").when(challenge | asked, "challenged").when(status.isin(401, 403, 451, 429), "blocked").when(status.between(200, 299), "allowed").otherwise("error")


def differs_by_agent(status_a: Column, status_b: Column, bytes_a: Column, bytes_b: Column, share: float = 0.3) -> Column:
    """Whether two answers to the same request differ in status, or in size by more than ``share`` of the larger."""
    return (status_a != status_b) | (F.abs(bytes_a - bytes_b) > F.greatest(bytes_a, bytes_b) * share)


ASSET_PATHS = ["/_astro/%", "%.css", "%.js", "%.png", "%.svg", "%.ico", "%.woff", "%.woff2", "%.jpg", "%.jpeg", "%.webp", "/favicon%"]
ENDPOINT_PATHS = ["/api/v1/search%", "/mcp", "/agent/%", "%llms.txt%", "%.md"]
PROBE_PATHS = ["%.env%", "%.php%", "%wp-%", "%.git%", "%credential%", "%aws%", "%service%account%", "%.ssh%", "%.sql%", "%backup%", "%phpmyadmin%"]


def path_like(path: Column, patterns: list[str]) -> Column:
    """Whether ``path`` is like one of the patterns, whatever its case; null is like none."""
    p = F.coalesce(path, F.lit(""))
    out = F.lit(False)
    for x in patterns:
        out = out | p.ilike(x)
    return out


def signature_state(inputs: Column, signature: Column, now: Column) -> Column:
    """State of a signed request (RFC 9421 headers, times in seconds) before any cryptography: absent, malformed (one header without the
    other, no key, no creation time or no signature value under the same label), expired, not_yet (created in the future), unverified."""
    label = F.regexp_extract(inputs, r"^\s*([a-z][\w\-]*)=\(", 1)
    part = lambda k: F.nullif(F.regexp_extract(inputs, rf';\s*{k}="?([^";]+)"?', 1), F.lit(""))
    created, expires = part("created").try_cast("long"), part("expires").try_cast("long")
    value = F.regexp_extract(signature, r"^\s*([a-z][\w\-]*)=:[A-Za-z0-9+/=]+:\s*$", 1)
    bad = inputs.isNull() | signature.isNull() | (label == "") | (label != value) | part("keyid").isNull() | created.isNull()
    return F.when(inputs.isNull() & signature.isNull(), "absent").when(F.coalesce(bad, F.lit(True)), "malformed").when(expires <= now, "expired").when(created > now, "not_yet").otherwise("unverified")
