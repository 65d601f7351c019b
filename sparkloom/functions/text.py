"""Column functions over names, descriptions, URLs and tags. Every function maps null to null unless it says otherwise."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Labels in front of a registered name, category keywords, licence names, media types, units.
HOST_LABELS = ["www", "api", "apis", "developer", "developers", "docs", "portal", "data", "rest", "app", "gateway", "services", "dev"]
CATEGORIES = {
    "Code & Development": "debug refactor code-review lint format git commit merge diff snippet ide editor coding developer compile syntax clean-code code-quality review",
    "Web & Frontend": "react vue svelte angular css html tailwind nextjs next nuxt astro component ui ux design landing-page frontend web responsive sass styled animation layout dom browser",
    "Testing & QA": "test testing jest vitest mocha cypress playwright e2e unit-test coverage qa assert spec tdd bdd mock fixture snapshot benchmark",
    "Data & Documents": "pdf xlsx docx csv json xml yaml data parse transform etl pipeline spreadsheet document excel word powerpoint pptx markdown md file convert extract report template",
    "DevOps & Infrastructure": "docker kubernetes k8s terraform aws gcp azure cloud ci cd deploy devops infrastructure infra nginx linux server monitoring logging helm ansible vagrant container serverless lambda",
    "API & Backend": "api rest graphql grpc server database sql postgres mysql mongo redis backend endpoint schema migration orm prisma supabase firebase auth middleware route express fastify",
    "AI & Automation": "llm ai claude gpt openai anthropic prompt agent mcp model embedding vector rag chain automation workflow bot copilot assistant chat langchain llama transformer fine-tune train",
}
DEFAULT_CATEGORY = "Productivity & Other"
SPDX_NAMES = {
    "mit": "MIT", "apache 2 0": "Apache-2.0", "apache 2": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "apache": "Apache-2.0",
    "bsd 3 clause": "BSD-3-Clause", "bsd 2 clause": "BSD-2-Clause", "isc": "ISC", "mpl 2 0": "MPL-2.0", "gpl 3 0": "GPL-3.0-only", "lgpl 3 0": "LGPL-3.0-only",
    "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "creative commons zero": "CC0-1.0", "public domain": "CC0-1.0", "cc by": "CC-BY-4.0", "cc by 4 0": "CC-BY-4.0",
    "creative commons attribution 4 0": "CC-BY-4.0", "creative commons attribution": "CC-BY-4.0", "cc by 3 0": "CC-BY-3.0", "creative commons attribution 3 0": "CC-BY-3.0",
    "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "ogl uk 3 0": "OGL-UK-3.0", "ogl": "OGL-UK-3.0", "open government": "OGL-UK-3.0", "open government v3": "OGL-UK-3.0",
    "open government licence": "OGL-UK-3.0", "open government licence v3": "OGL-UK-3.0", "open government license": "OGL-UK-3.0", "lov2": "etalab-2.0", "licence ouverte 2 0": "etalab-2.0",
    "licence ouverte": "etalab-2.0", "etalab 2 0": "etalab-2.0", "etalab": "etalab-2.0", "odc odbl": "ODbL-1.0", "odbl": "ODbL-1.0", "odbl 1 0": "ODbL-1.0", "odc by": "ODC-By-1.0", "pddl": "PDDL-1.0",
}
MEDIA_FORMATS = {
    "application/json": "json", "text/json": "json", "application/xml": "xml", "text/xml": "xml", "text/csv": "csv", "text/plain": "text", "application/x-ndjson": "ndjson",
    "application/jsonlines": "ndjson", "application/geo+json": "geojson", "application/ld+json": "jsonld", "text/html": "html", "application/pdf": "pdf", "application/octet-stream": "binary",
    "application/zip": "zip", "application/x-protobuf": "protobuf", "application/grpc": "protobuf", "application/yaml": "yaml", "application/x-yaml": "yaml", "text/yaml": "yaml",
    "application/rss+xml": "rss", "application/atom+xml": "atom",
}
UNITS = {"s": "second", "sec": "second", "second": "second", "seconde": "second", "min": "minute", "minute": "minute", "h": "hour", "hour": "hour", "heure": "hour", "day": "day", "jour": "day", "month": "month", "mois": "month"}
TAG = r"^([a-z][a-z_]{0,31}):([a-z0-9][a-z0-9-]{0,63})$"
LANGUAGE_SUFFIX = r"(?i)-(ar|de|es|fr|ja|ko|pt|ru|zh|zh-cn|zh-tw|zhs|zht|it|nl|pl|tr|hi|id|vi|th|sv|da|no|fi|cs|el|he|uk)$"
STOP_WORDS = "a an and are as at be by can for from how if in into is it its of on or our so than that the their them then these they this to use using was we were when which while will with you your".split()


def literal_map(values: dict[str, str]) -> Column:
    """A constant map for lookups inside an expression."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def host_of(url: Column) -> Column:
    """Lower-cased host without port; '' where the URL has no scheme or host, and for null."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """``host`` without one leading service label, where more than two labels remain."""
    first = F.element_at(F.split(host, r"\."), 1)
    return F.when((F.size(F.split(host, r"\.")) > 2) & first.isin(HOST_LABELS), F.substring(host, F.length(first) + 2, 2**30)).otherwise(host)


def slug(text: Column) -> Column:
    """Lower-cased, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def name_stem(name: Column) -> Column:
    """Slug of ``name`` without api- in front and -api behind; null where nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(slug(name), r"^api-", ""), r"-api$", "")
    return F.nullif(F.when(stem == "api", "").otherwise(stem), F.lit(""))


def merge_key(url: Column, name: Column) -> Column:
    """canonical host / name stem; null unless both are known."""
    host = F.nullif(canonical_host(host_of(url)), F.lit(""))
    return F.concat(host, F.lit("/"), name_stem(name))


def category_slug(category: Column) -> Column:
    """Slug with & spelled out."""
    return slug(F.replace(category, F.lit("&"), F.lit("and")))


def categorize(name: Column, *texts: Column) -> Column:
    """Category with the most keyword hits in all texts, a hit in the name counting three; the earlier category on ties, a default without hits."""
    name_l = F.lower(F.coalesce(name, F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), *[F.coalesce(t, F.lit("")) for t in texts]))
    table = F.array(*[F.array(*[F.lit(w) for w in words.split()]) for words in CATEGORIES.values()])

    def scores(x: Column) -> Column:
        hit = lambda w: F.when(F.contains(x.t, w), F.when(F.contains(x.n, w), 3).otherwise(1)).otherwise(0)
        return F.transform(table, lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + hit(w)))

    # The texts are bound once, not built again for every keyword.
    best = F.element_at(F.transform(F.array(F.struct(text.alias("t"), name_l.alias("n"))), scores), 1)
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    pick = lambda b: F.when(F.array_max(b) > 0, F.element_at(names, F.array_position(b, F.array_max(b)).cast("int"))).otherwise(F.lit(DEFAULT_CATEGORY))
    return F.element_at(F.transform(F.array(best), pick), 1)


def valid_tags(tags: Column) -> Column:
    """Distinct well-formed tags in code-point order; null gives an empty array."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & t.rlike(TAG))))


def clean_name(name: Column) -> Column:
    """Trimmed, lower-cased, white space as hyphens, only word characters and hyphens, at most 64."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-"), r"[^a-z0-9_-]", ""), 1, 64)


def clean_description(text: Column) -> Column:
    """White space collapsed, trimmed, at most 1,024 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 1024)


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    """At most ``n`` characters, with ``mark`` behind where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def first_paragraph(text: Column) -> Column:
    """First run of prose lines: headings, rules, table rows and blank lines before it are skipped; at most 500 characters. '' where there is none."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    skip = lambda x: (x == "") | x.rlike(r"^(#|---|\||```|~~~)")
    prose = F.array_join(F.transform(lines, lambda x: F.when(skip(x), F.lit("\u0001")).otherwise(x)), "\n")
    return F.substring(F.trim(F.replace(F.regexp_extract(prose, r"(?:^|\n|\x01)([^\x01\n][^\x01]*)", 1), F.lit("\n"), F.lit(" "))), 1, 500)


def spdx_of(name: Column) -> Column:
    """SPDX id of a licence name, or of a licence page address at spdx.org; null where it is unknown."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", " "))
    table = literal_map(SPDX_NAMES)
    stripped = F.regexp_replace(F.lower(F.trim(name)), r"\s+licen[cs]e$", "")
    by_url = F.nullif(F.regexp_extract(name, r"spdx\.org/licenses/([A-Za-z0-9.+-]+)", 1), F.lit(""))
    return F.coalesce(F.try_element_at(table, norm(stripped)), F.try_element_at(table, norm(name)), by_url)


def media_formats(types: Column) -> Column:
    """Formats of media types, distinct in order of first mention; unknown types are dropped, null gives an empty array."""
    table = literal_map(MEDIA_FORMATS)

    def one(t: Column) -> Column:
        m = F.trim(F.element_at(F.split(F.lower(t), ";"), 1))
        return F.coalesce(F.try_element_at(table, m), F.when(m.startswith("image/"), "image").when(m.endswith("+json"), "json").when(m.endswith("+xml"), "xml"))

    return F.array_distinct(F.filter(F.transform(F.coalesce(types, F.array().cast("array<string>")), one), lambda x: x.isNotNull()))


def rate_limit(text: Column) -> Column:
    """struct(requests, per) read from English or French free text; both null unless both are found."""
    strict = r"(?i)^\s*(\d[\d,.]*)\s*(?:req|requests|calls|appels)?\s*(?:/|per|par)\s*(second|sec|s|minute|min|hour|h|day|jour|month|mois)\b"
    loose = r"(?i)(\d[\d\s,.]*)\s*(?:req|requests|requêtes|requetes|calls|appels|hits)?\s*(?:/|per|par)\s*(seconde|second|sec|s|minute|min|heure|hour|h|jour|day|mois|month)\b"
    pick = lambda g: F.when(text.rlike(strict), F.regexp_extract(text, strict, g)).otherwise(F.regexp_extract(text, loose, g))
    digits = F.regexp_replace(pick(1), r"[\s,]", "")
    number = F.when(digits.rlike(r"^\d{1,3}(\.\d{3}){1,9}$"), F.replace(digits, F.lit("."), F.lit(""))).otherwise(digits)
    n = F.floor(number.try_cast("double") + 0.5).cast("long")
    per = F.try_element_at(literal_map(UNITS), F.lower(pick(2)))
    ok = (n > 0) & per.isNotNull()
    return F.struct(F.when(ok, n).alias("requests"), F.when(ok, per).alias("per"))


def auth_type(scheme_type: Column, scheme: Column) -> Column:
    """Security scheme of an API description as one word."""
    t, s = F.lower(F.coalesce(scheme_type, F.lit(""))), F.lower(F.coalesce(scheme, F.lit("")))
    return F.when(t == "apikey", "api_key").when((t == "http") & (s == "bearer"), "bearer").when((t == "http") & (s == "basic"), "http_basic").when(t == "oauth2", "oauth2").when(t == "openidconnect", "openid").otherwise("unknown")


def listed_auth(auth: Column) -> Column:
    """Auth column of an open API list as one word."""
    return F.when(auth.isin("", "No", "User-Agent"), "none").when(auth.isin("apiKey", "X-Mashape-Key"), "api_key").when(auth == "OAuth", "oauth2").otherwise("unknown")


def prefers_markdown(accept: Column) -> Column:
    """True where an Accept header gives text/markdown a weight above 0 and not below that of text/html."""
    parts = F.transform(F.split(F.lower(accept), ","), lambda p: F.struct(F.trim(F.element_at(F.split(p, ";"), 1)).alias("t"), F.coalesce(F.nullif(F.regexp_extract(p, r";\s*q\s*=\s*([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0)).alias("q")))
    weight = lambda kinds: F.coalesce(F.array_max(F.transform(F.filter(parts, lambda x: x.t.isin(kinds)), lambda x: x.q)), F.lit(0.0))
    return F.coalesce((weight(["text/markdown", "text/x-markdown"]) > 0) & (weight(["text/markdown", "text/x-markdown"]) >= weight(["text/html", "application/xhtml+xml"])), F.lit(False))


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits without stop words and single characters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def mentions(text: Column, pattern: str) -> Column:
    """True where ``text`` (lower-cased) has ``pattern``; patterns of four characters or fewer must stand as words."""
    p = pattern.lower()
    return text.rlike(r"\b" + re.escape(p) + r"\b") if len(p) <= 4 else F.contains(text, F.lit(p))


def json_ld_scripts(page: Column) -> Column:
    """Number of JSON-LD script elements of an HTML page."""
    return F.regexp_count(page, F.lit(r"(?i)<script[^>]+type=[\"']application/ld\+json[\"']"))


def vector_id(record_id: Column) -> Column:
    """Id of at most 64 safe characters: the sanitised id, or a hash of it where it is longer."""
    return F.when(F.length(record_id) <= 64, F.regexp_replace(record_id, r"[^A-Za-z0-9_-]", "_")).otherwise(F.concat(F.lit("sk_"), F.substring(F.sha2(record_id, 256), 1, 40)))


def record_page(name: Column, description: Column, repository: Column, score: Column, tags: Column) -> Column:
    """A record as a Markdown page: title, description where there is one, repository, score, tags in order."""
    line = lambda k, v: F.concat(F.lit(f"- {k}: "), v, F.lit("\n"))
    about = F.when(description.isNull(), "").otherwise(F.concat(description, F.lit("\n\n")))
    marks = F.when(F.size(tags) > 0, line("tags", F.array_join(F.array_sort(tags), ", "))).otherwise("")
    return F.concat(F.lit("# "), F.coalesce(name, F.lit("untitled")), F.lit("\n\n"), about, line("repository", F.coalesce(repository, F.lit("unknown"))), line("score", F.coalesce(score.cast("string"), F.lit("-"))), marks)


@F.pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """``text`` decomposed and without combining marks; there is no such function in the JVM."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|amp|lt|gt|quot|apos|nbsp);")


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """``text`` with numeric and the six common named entities decoded; others stay as they are."""
    return text.map(lambda t: None if t is None else _ENTITY.sub(lambda m: " " if m.group() == "&nbsp;" else html.unescape(m.group()), t))
