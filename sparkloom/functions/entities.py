"""What depends on the type of a record: packs of gates over its own fields, embedding inputs, total scores; and small tests of single fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, scoring

# Countries of the EU, the EEA and the United Kingdom.
EEA = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE IS LI NO GB".split()


def in_eea(country: Column) -> Column:
    """Whether an upper-case country code is one of the EU, the EEA or the United Kingdom; false for null."""
    return F.coalesce(country.isin(EEA), F.lit(False))


def valid_slug(slug: Column) -> Column:
    """Whether a slug can be a path below the site: not empty, no parent steps, no leading slash, no backslash."""
    s = F.coalesce(slug, F.lit(""))
    return (s != "") & ~F.contains(s, F.lit("..")) & ~F.startswith(s, F.lit("/")) & ~F.contains(s, F.lit("\\"))


def needs_walk(walked_at: Column, pushed_at: Column, full: bool = False) -> Column:
    """Whether a repository must be walked again: always on a full pass or where it never was, else where it was pushed to since (ISO text)."""
    return F.lit(full) | walked_at.isNull() | F.coalesce(pushed_at > walked_at, F.lit(False))


def listed(name: Column, names: list[str]) -> Column:
    """Exact, case-sensitive membership of a short list; false for null."""
    return F.coalesce(name.isin(names), F.lit(False)) if names else F.lit(False)


def _n(*arrays: Column) -> Column:
    return sum((F.coalesce(F.size(a), F.lit(0)) for a in arrays), F.lit(0))


def plugin_gates(description: Column, manifest: Column, listings: Column, components: list[Column], least: int = 50, floor: int = 1) -> list[tuple[str, Column]]:
    """Gates of a plugin: described, with a manifest (map) or a listing, and with at least ``floor`` components."""
    bare = (F.coalesce(F.size(manifest), F.lit(0)) <= 0) & (_n(listings) < 1)
    return [("short_description", rules.short_description(description, least)), ("no_manifest", bare), ("no_components", _n(*components) < floor)]


def server_gates(description: Column, transport: Column, tools: Column, least: int = 50) -> list[tuple[str, Column]]:
    return [("short_description", rules.short_description(description, least)), ("no_transport", transport.isNull()), ("no_tools", _n(tools) < 1)]


def dataset_gates(description: Column, home_url: Column, least: int = 50) -> list[tuple[str, Column]]:
    return [("short_description", rules.short_description(description, least)), ("no_home", rules.text(home_url) == "")]


def _join(parts: list[Column], limit: int) -> Column:
    return F.substring(F.concat_ws(" | ", *[F.coalesce(p, F.lit("")) for p in parts]), 1, limit)


def _list(a: Column, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull()), sep)


#: entity type -> builder of the text that is embedded for its records; arguments are named columns.
EMBEDDING_INPUTS: dict[str, Callable[..., Column]] = {
    "skill": lambda name, description, category, body: F.substring(F.array_join(F.filter(F.array(name, description, category, F.substring(body, 1, 1500)), lambda x: x.isNotNull() & (x != "")), "\n\n"), 1, 6000),
    "plugin": lambda name, description, keywords: _join([name, description, _list(keywords)], 200),
    "mcp_server": lambda name, description, transport, tools: _join([name, description, F.concat(F.lit("transport="), F.coalesce(transport, F.lit("null"))), F.concat(F.lit("tools: "), _list(tools))], 200),
    "api": lambda name, provider, description, categories: _join([name, provider, description, _list(categories)], 300),
    "dataset": lambda name, publisher, description, tags, formats: _join([name, publisher, description, _list(F.transform(tags, lambda t: F.regexp_replace(t, "^category:", ""))), _list(formats)], 300),
}


def total_score(entity_type: Column, signals: dict[str, dict[str, Column]]) -> Column:
    """Total of a record by its type from ``signals`` (type -> signal -> Column); types without signals score 0."""
    out = None
    for kind, s in signals.items():
        w = scoring.weighted(s, scoring.FEED_WEIGHTS if kind in ("api", "dataset") else scoring.RECORD_WEIGHTS)
        out = F.when(entity_type == kind, w) if out is None else out.when(entity_type == kind, w)
    return F.lit(0).cast("long") if out is None else out.otherwise(0).cast("long")
