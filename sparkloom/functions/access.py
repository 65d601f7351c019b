"""Access blocks of listings: cost, auth, licence, limits and formats, each with where it was found and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of auth types, how sure each place of finding is.
AUTH_ORDER = ["api_key", "bearer", "oauth2", "http_basic", "openid"]
CONFIDENCE = {"spec_auth": 0.9, "spec_license": 0.9, "spec_formats": 0.8, "spec_transport": 0.9, "portal_rate": 0.8, "portal_access": 0.7, "portal_license": 0.9, "table_license": 0.8, "list_auth": 0.6, "cost_free": 0.7, "list_base_url": 0.5}


def found(value: Column, method: str) -> Column:
    """struct(value, method, confidence); null where the value is unknown."""
    known = value.isNotNull() & ~value.cast("string").isin("", "unknown")
    return F.when(known, F.struct(value.alias("value"), F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence")))


def best(*candidates: Column) -> Column:
    """The surest of several findings of one field, the earlier on ties; null where there is none."""
    known = F.array_compact(F.array(*candidates))
    first = lambda a: F.aggregate(a, a[0], lambda s, x: F.when(x.confidence > s.confidence, x).otherwise(s))
    return F.when(F.size(known) > 0, first(known))


def confidence(c: Column) -> Column:
    """Confidence within 0..1; 1 where it is missing or no number."""
    return F.when(c.isNull() | F.isnan(c), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def scheme_of(schemes: Column, required: Column) -> Column:
    """Auth type of an API: of the first required scheme (name, type) that is known, else the first in AUTH_ORDER; none where no scheme is known."""
    known = F.filter(schemes, lambda s: s.type != "unknown")
    named = F.element_at(F.transform(F.filter(required, lambda r: F.exists(known, lambda s: s["name"] == r)), lambda r: F.filter(known, lambda s: s["name"] == r)[0].type), 1)
    ordered = F.element_at(F.filter(F.array(*[F.lit(a) for a in AUTH_ORDER]), lambda a: F.exists(known, lambda s: s.type == a)), 1)
    some = F.size(F.coalesce(known, F.array().cast("array<struct<name:string,type:string>>"))) > 0
    first_named = F.when(F.size(F.filter(required, lambda r: F.exists(known, lambda s: s["name"] == r))) > 0, named)
    return F.when(some, F.coalesce(first_named, F.when(F.exists(known, lambda s: s.type.isin(AUTH_ORDER)), ordered), F.lit("none"))).otherwise("none")


def cost_label(c: Column) -> Column:
    return F.when(c == "free", "Free").when(c == "freemium", "Free tier").when(c == "paid", "Paid").otherwise("Unknown")


def limit_label(requests: Column, per: Column) -> Column:
    return F.when(requests.isNotNull() & per.isNotNull(), F.concat(requests.cast("string"), F.lit(" per "), per)).otherwise("Unknown")


def bytes_label(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n.isNull(), "-").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / 1048576), F.lit(" MB")))


def ago(days: Column) -> Column:
    """Age as today, days, months or years."""
    n = lambda k: F.floor(days / k).cast("string")
    return F.when(days.isNull(), "unknown").when(days < 1, "today").when(days < 30, F.concat(n(1), F.lit("d"))).when(days < 365, F.concat(n(30), F.lit("mo"))).otherwise(F.concat(n(365), F.lit("y")))


#: What a refusal of the credentials themselves says.
REFUSALS = r"(?i)bad credentials|token .{0,40}(?:expired|revoked)|requires authentication|resource not accessible"


def refuses_credentials(status: Column, retry_after: Column, remaining: Column, body: Column) -> Column:
    """Whether an answer refuses the credentials, so that trying again is useless: 401 always; 403 where no limit explains it and the body says so."""
    limited = retry_after.isNotNull() | F.coalesce(remaining == 0, F.lit(False))
    return F.coalesce(status == 401, F.lit(False)) | (F.coalesce(status == 403, F.lit(False)) & ~limited & F.coalesce(body, F.lit("")).rlike(REFUSALS))


def credential_level(status: Column, days_left: Column, warn_days: float = 14) -> Column:
    """fail where credentials are missing (null status), refused or expired, warn where they expire within ``warn_days``, else ok; null days mean that they do not expire."""
    return F.when(F.coalesce(status, F.lit(0)) != 200, "fail").when(days_left <= 0, "fail").when(days_left < warn_days, "warn").otherwise("ok")
