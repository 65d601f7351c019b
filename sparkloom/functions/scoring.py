"""Signals of 0 to 100 and their weighted totals. Times are measured against an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the totals, permissive licences, neutral signals.
RECORD_WEIGHTS = {"stars": 0.20, "recency": 0.20, "main": 0.20, "docs": 0.15, "issues": 0.10, "license": 0.10, "description": 0.05}
FEED_WEIGHTS = {"access": 0.20, "reachability": 0.15, "docs": 0.15, "license": 0.15, "freshness": 0.15, "popularity": 0.15, "adoption": 0.05}
PERMISSIVE = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "0BSD"]
NEUTRAL_REACHABILITY, NEUTRAL_POPULARITY, NEUTRAL_FRESHNESS = 70, 50, 50


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + 0.5)


def stars(n: Column) -> Column:
    """Logarithmic: 0 at none, 100 from about a thousand."""
    return F.when(n > 0, F.least(F.lit(100), half_up(F.log10(n + 1) * 33.3))).otherwise(0).cast("long")


def ladder(days: Column, steps: list[tuple[int, int]], beyond: int, unknown: int) -> Column:
    """Value of the first step that ``days`` does not exceed."""
    out = None
    for limit, value in steps:
        out = F.when(days <= limit, value) if out is None else out.when(days <= limit, value)
    return F.when(days.isNull(), unknown).otherwise(out.otherwise(beyond))


def days_before(at: Column, as_of: str) -> Column:
    """Days, with fractions, from ``at`` (timestamp or ISO string) to ``as_of``; null where ``at`` is no time."""
    return (F.lit(as_of).cast("timestamp").cast("double") - at.try_cast("timestamp").cast("double")) / 86400.0


def recency(at: Column, as_of: str) -> Column:
    return ladder(days_before(at, as_of), [(7, 100), (30, 90), (90, 75), (180, 50), (365, 25)], 5, 0)


def dataset_freshness(at: Column, as_of: str) -> Column:
    return ladder(days_before(at, as_of), [(30, 100), (90, 90), (180, 75), (365, 50), (730, 25)], 5, 0)


def frontmatter(name: Column, description: Column, extra_fields: Column) -> Column:
    """From the fields a document declares about itself; ``extra_fields`` is how many others it declares."""
    described = F.when(F.length(description) > 10, 40).when(F.length(description) > 0, 20).otherwise(0)
    return F.least(F.lit(100), F.when(F.length(name) > 0, 30).otherwise(0) + described + F.when(extra_fields >= 3, 30).when(extra_fields >= 1, 15).otherwise(0))


def docs(body_length: Column, repo_description: Column, description: Column) -> Column:
    body = F.when(body_length > 2000, 50).when(body_length > 500, 35).when(body_length > 100, 20).otherwise(5)
    return F.least(F.lit(100), body + F.when(F.length(repo_description) > 20, 30).when(F.length(repo_description) > 0, 15).otherwise(0) + F.when(F.length(description) > 50, 20).when(F.length(description) > 0, 10).otherwise(0))


def issues(open_issues: Column, star_count: Column) -> Column:
    ratio = open_issues / star_count
    starred = F.when(ratio < 0.05, 90).when(ratio < 0.1, 75).when(ratio < 0.3, 50).when(ratio < 0.5, 30).otherwise(10)
    bare = F.when(open_issues > 10, 20).when(open_issues > 5, 40).otherwise(60)
    return F.when(F.coalesce(open_issues, F.lit(0)) == 0, 80).when(star_count > 0, starred).otherwise(bare)


def license_score(spdx: Column) -> Column:
    return F.when(spdx.isNull() | spdx.isin("", "NOASSERTION"), 0).when(spdx.isin(PERMISSIVE), 100).otherwise(70)


def description_score(text: Column) -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n > 50, 100).when(n > 20, 60).when(n > 0, 30).otherwise(0)


def manifest_share(*checks: Column) -> Column:
    """Share of the checks that hold; null counts as not."""
    return sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0)) / float(len(checks))


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of signals, clamped to 0..100 and rounded half up; null signals count as 0."""
    total = sum((F.coalesce(signals[k], F.lit(0)) * w for k, w in weights.items()), F.lit(0.0))
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))).cast("long")


def feed_docs(docs_url: Column, spec: Column, description: Column) -> Column:
    """``spec`` tells whether a machine-readable description is there."""
    return F.least(F.lit(100.0), F.when(F.length(docs_url) > 0, 40).otherwise(0) + F.when(spec, 40).otherwise(0) + description_score(description) * 0.2)


def access_clarity(auth: Column, cost: Column, requests: Column, confidence: float = 1.0) -> Column:
    """Mean of three parts: auth, cost and rate limit known, each worth its confidence."""
    known = lambda c: F.when(c.isNotNull() & ~c.cast("string").isin("", "unknown"), confidence).otherwise(0.0)
    return (known(auth) + known(cost) + known(requests)) / 3


def adoption(consumers: Column) -> Column:
    return F.least(F.lit(100), F.coalesce(consumers, F.lit(0)) * 20)


def novelty(top_similarity: Column) -> Column:
    """1 - similarity of the nearest neighbour, within 0..1; 1 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(top_similarity, F.lit(0.0))))


def trending_weight(score: Column, novelty_score: Column) -> Column:
    return F.coalesce(score, F.lit(0)) + 100 * F.coalesce(novelty_score, F.lit(0.0))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """100 * part / whole rounded half up; 0 where the whole is 0 or null."""
    k = 10.0**places
    return F.when(whole > 0, half_up(part * 100.0 / whole * k) / k).otherwise(0.0)


# Weights and bounds of the session and behaviour scores.
SESSION_WEIGHTS = {"markdown": 0.5, "endpoint": 0.4, "no_assets": 0.4, "incoherent": 0.2, "one_each": 0.15, "assets": -0.4, "browser": -0.2, "residential": -0.2}
SESSION_BASE, AGENT_FROM, HUMAN_BELOW = 0.3, 0.6, 0.3
BEHAVIOUR_WEIGHTS = {"mouse": 0.3, "wheel": 0.2, "teleport": 0.25, "moves": 0.15, "spread": 0.1}
MIN_INTERACTIONS, AUTOMATION_FROM, HUMAN_TO = 12, 0.6, 0.4


def session_score(a: dict[str, Column]) -> Column:
    """struct(score, band, method, single_fetch) of a session.

    ``a`` has total, paths, content, assets, markdown, endpoint, incoherent, token, mcp (numbers; null counts as 0) and asn_class.
    """
    n = {k: F.coalesce(c, F.lit(0)) for k, c in a.items() if k != "asn_class"}
    ratio = F.when(n["assets"] + n["content"] > 0, n["assets"] / (n["assets"] + n["content"])).otherwise(0.0)
    w = SESSION_WEIGHTS
    told = [
        (n["markdown"] > 0, w["markdown"]),
        (n["endpoint"] > 0, w["endpoint"]),
        ((ratio < 0.1) & (n["content"] >= 1), w["no_assets"]),
        (n["incoherent"] > 0, w["incoherent"]),
        ((n["paths"] >= 3) & (n["total"] <= n["paths"] + 1), w["one_each"]),
        (ratio >= 0.5, w["assets"]),
        ((n["incoherent"] == 0) & (n["total"] >= 3) & (ratio > 0), w["browser"]),
        (F.coalesce(a["asn_class"] == "isp_residential", F.lit(False)), w["residential"]),
    ]
    raw = sum((F.when(c, x).otherwise(0.0) for c, x in told), F.lit(SESSION_BASE))
    cooperative = (n["token"] > 0) | (n["mcp"] > 0)
    # Rounded so that sums that are equal on paper fall into the same band.
    score = F.when(cooperative, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6))
    lone = (n["total"] == 1) & (n["markdown"] == 0) & (n["endpoint"] == 0) & ~cooperative
    band = F.when((score >= AGENT_FROM) & ~lone, "agent-shaped").when(score >= HUMAN_BELOW, "uncertain").otherwise("human-shaped")
    single = (n["total"] == 1) & (n["assets"] == 0) & (n["content"] >= 1) & (band != "agent-shaped") & ~cooperative
    return F.struct(score.alias("score"), band.alias("band"), F.when(cooperative, "cooperative").otherwise("session_shape").alias("method"), single.alias("single_fetch"))


def behaviour_score(mouse_rate: Column, has_wheel: Column, teleport: Column, clicks: Column, moves: Column, spread: Column, interactions: Column) -> Column:
    """struct(score, band) of pointer behaviour; null numbers count as 0."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    m, t, k, p, s, i = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (mouse_rate, teleport, clicks, moves, spread, interactions))
    w, enough = BEHAVIOUR_WEIGHTS, i >= MIN_INTERACTIONS
    score = F.when(k > 0, unit((5 - m) / 5)).otherwise(0.0) * w["mouse"]
    score = score + F.when(enough & ~F.coalesce(has_wheel, F.lit(False)), 1.0).otherwise(0.0) * w["wheel"]
    score = score + F.when(k > 0, unit(t)).otherwise(0.0) * w["teleport"] + F.when(enough, unit((20 - p) / 20)).otherwise(0.0) * w["moves"] + F.when(k >= 2, unit((10 - s) / 10)).otherwise(0.0) * w["spread"]
    score = F.round(unit(score), 6)
    return F.struct(score.alias("score"), F.when(~enough, "uncertain").when(score >= AUTOMATION_FROM, "automation-signature").when(score <= HUMAN_TO, "human-shaped").otherwise("uncertain").alias("band"))
