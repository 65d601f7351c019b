"""Record rules: predicates and first-failing gates per entity type. All predicates are true or false, never null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Template names, placeholder beginnings, patterns of hollow names, content rules with the token that must be there first.
TEMPLATE_NAMES = ["agent-name", "skill-name", "example", "example-skill", "template", "my-skill", "sample", "sample-skill", "untitled", "new-skill", "placeholder", "test", "test-skill", "hello-world", "default"]
PLACEHOLDER_STARTS = ["^one paragraph describing", "^describe what this", "^your description here", r"^\[.*\]", "^brief description of", "^this is a (sample|test|placeholder|template)"]
HOLLOW_NAMES = ["^(carrier|customs|energy|inventory|logistics|production|quality|returns|warehouse|fleet|freight|procurement|supply-chain|vendor|contract|compliance|audit|risk|incident|outage|regulatory)-", "-management$", "-compliance$", "-optimization$"]
CONTENT_RULES = {
    "curl_pipe_sh": ("curl", r"curl[^\n|]{0,300}\|\s*(?:ba|z|da)?sh\b"),
    "wget_pipe_sh": ("wget", r"wget[^\n|]{0,300}\|\s*(?:ba|z)?sh\b"),
    "base64_decode_exec": ("base64", r"base64\s+(?:-d|--decode)[^\n]{0,120}\|\s*(?:ba|z)?sh\b"),
    "env_secret_to_url": ("http", r"\$\{?[A-Z_]*(?:API_KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL)[A-Z_]*\}?[^\n]{0,200}https?://"),
    "exfil_endpoints": ("", r"(?i)(?:webhook\.site|requestbin|pipedream\.net|burpcollaborator|interactsh|oastify\.com)"),
    "reverse_shell": ("", r"(?:/dev/tcp/\d|nc\s+-e\s+/bin|mkfifo\s+/tmp/)"),
    "ignore_previous": ("ignore", r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions"),
    "override_system": ("", r"(?i)(?:override|bypass)\s+(?:the\s+)?(?:system\s+prompt|safety\s+guidelines|guardrails)"),
    "dan_mode": ("", r"(?i)\b(?:DAN mode|do anything now)\b"),
    "im_start_system": ("<|im_start|>", r"<\|im_start\|>\s*system"),
    "new_system_prompt": ("", r"(?i)your\s+new\s+(?:system\s+)?(?:instructions|prompt)\s+(?:are|is)"),
}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_like(c: Column, patterns: list[str]) -> Column:
    return text(c).rlike("|".join(f"(?:{p})" for p in patterns))


def template_name(name: Column) -> Column:
    return F.lower(text(name)).isin(TEMPLATE_NAMES)


def placeholder_description(description: Column) -> Column:
    return any_like(F.lower(description), PLACEHOLDER_STARTS)


def hollow_name(name: Column) -> Column:
    return any_like(F.lower(name), HOLLOW_NAMES)


def short_description(description: Column, least: int) -> Column:
    return F.length(F.trim(text(description))) < least


def content_flags(body: Column, rules: dict[str, tuple[str, str]] = CONTENT_RULES) -> Column:
    """Sorted names of the rules that the text meets. A cheap token test goes before each expression."""
    low = F.lower(text(body))
    return F.array_sort(F.array_compact(F.array(*[F.when((F.contains(low, F.lit(token)) if token else F.lit(True)) & text(body).rlike(p), F.lit(name)) for name, (token, p) in rules.items()])))


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate whose condition holds; null where none does."""
    out = None
    for name, c in gates:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


#: entity type -> gates over a row's columns, in order. New types are added by registering them here.
GATES: dict[str, Callable[[], list[tuple[str, Column]]]] = {}


def gates_for(entity_type: str):
    def register(f: Callable[[], list[tuple[str, Column]]]):
        GATES[entity_type] = f
        return f

    return register


def common_gates() -> list[tuple[str, Column]]:
    return [("template_name", template_name(F.col("name"))), ("placeholder_description", placeholder_description(F.col("description"))), ("hollow_name", hollow_name(F.col("name")))]


@gates_for("skill")
def skill_gates() -> list[tuple[str, Column]]:
    return [("short_body", F.coalesce(F.col("body_length"), F.lit(0)) < 200), ("anonymous", (text(F.col("name")) == "") & (text(F.col("description")) == ""))]


@gates_for("plugin")
@gates_for("mcp_server")
def described_gates() -> list[tuple[str, Column]]:
    return [("short_description", short_description(F.col("description"), 30))]


@gates_for("api")
def api_gates() -> list[tuple[str, Column]]:
    bare = F.size(F.coalesce("extra.base_urls", F.array().cast("array<string>"))) == 0
    return [("short_description", short_description(F.col("description"), 50)), ("no_home", text(F.col("home_url")) == ""), ("no_endpoint", bare & F.col("extra.spec_version").isNull())]


def drop_reason(entity_type: Column, types: list[str] | None = None) -> Column:
    """First failing gate of a record of its type: the common ones, then those of the type; unknown types have the common ones only."""
    out = first_reason(common_gates())
    special = None
    for t in types or list(GATES):
        special = F.when(entity_type == t, first_reason(GATES[t]())) if special is None else special.when(entity_type == t, first_reason(GATES[t]()))
    return F.coalesce(out, special)
