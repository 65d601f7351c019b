"""API descriptions (OpenAPI 3, Swagger 2) as VARIANT: one profile per description, one row per operation. Nothing leaves the JVM.

Names and places of members are those of the two specifications. Objects of a VARIANT keep no order, so lists made from members are
sorted; members of another kind than the specification wants count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a path that are operations.
OPERATIONS = ["delete", "get", "head", "options", "patch", "post", "put", "trace"]
_MAP, _LIST = "map<string,variant>", "array<variant>"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _members(v: Column, path: str) -> Column:
    """Entries (key, value) of an object; null where there is none."""
    return F.map_entries(_at(v, path, _MAP))


def _all(x: Column) -> Column:
    """One flat array from an array of arrays of which some may be null."""
    return F.flatten(F.filter(x, lambda a: a.isNotNull()))


def _strings(v: Column, path: str) -> Column:
    return F.filter(F.transform(_at(v, path, _LIST), lambda x: _at(x, "$")), lambda x: x.isNotNull())


def _operations(spec: Column) -> Column:
    """array of (path, method, op)."""
    of_path = lambda p: F.transform(F.filter(_members(p.value, "$"), lambda o: o.key.isin(OPERATIONS)), lambda o: F.struct(p.key.alias("path"), o.key.alias("method"), o.value.alias("op")))
    return _all(F.transform(_members(spec, "$.paths"), of_path))


def _answers(op: Column) -> Column:
    """Media types that an operation answers with, by either specification."""
    return F.concat(F.coalesce(_all(F.transform(_members(op, "$.responses"), lambda r: F.map_keys(_at(r.value, "$.content", _MAP)))), F.array().cast("array<string>")), F.coalesce(_strings(op, "$.produces"), F.array().cast("array<string>")))


def _servers(spec: Column) -> Column:
    """Addresses: every server with the defaults of its variables, or every scheme (https where none is given) of host and base path."""
    filled = lambda s: F.aggregate(F.coalesce(_members(s, "$.variables"), F.filter(_members(F.parse_json(F.lit("{}")), "$"), lambda _: F.lit(False))), _at(s, "$.url"), lambda u, v: F.replace(u, F.concat(F.lit("{"), v.key, F.lit("}")), F.coalesce(_at(v.value, "$.default"), F.lit(""))))
    modern = F.filter(F.transform(_at(spec, "$.servers", _LIST), filled), lambda u: u.isNotNull() & (u != ""))
    host = F.concat(_at(spec, "$.host"), F.coalesce(_at(spec, "$.basePath"), F.lit("")))
    schemes = F.coalesce(F.when(F.size(_strings(spec, "$.schemes")) > 0, _strings(spec, "$.schemes")), F.array(F.lit("https")))
    older = F.when(host.isNotNull(), F.transform(schemes, lambda s: F.concat(s, F.lit("://"), host)))
    return F.coalesce(F.when(_at(spec, "$.swagger").isNotNull(), older).otherwise(modern), F.array().cast("array<string>"))


def api_profile(text: Column) -> Column:
    """struct of what a description says: standard, version, title, description, licence, terms, documentation, servers, operations (number),
    media (sorted), auth (name, kind, scheme by name), needs (names of required schemes), style. Null where ``text`` is no JSON object."""
    spec = F.try_parse_json(text)

    def of(s: Column) -> Column:
        auth = F.transform(F.coalesce(_members(s, "$.components.securitySchemes"), _members(s, "$.securityDefinitions")), lambda m: F.struct(m.key.alias("name"), _at(m.value, "$.type").alias("kind"), _at(m.value, "$.scheme").alias("scheme")))
        operations = F.coalesce(_operations(s), F.filter(_operations(F.parse_json(F.lit('{"paths": {}}'))), lambda _: F.lit(False)))
        media = F.concat(_all(F.transform(operations, lambda o: _answers(o.op))), F.coalesce(_strings(s, "$.produces"), F.array().cast("array<string>")))
        needs = _all(F.transform(_at(s, "$.security", _LIST), lambda r: F.map_keys(_at(r, "$", _MAP))))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(_at(s, "$.openapi").isNotNull(), "openapi").when(_at(s, "$.swagger").isNotNull(), "swagger").alias("standard"), F.coalesce(_at(s, "$.openapi"), _at(s, "$.swagger")).alias("version"), _at(s, "$.info.title").alias("title"), _at(s, "$.info.description").alias("description"),
            F.coalesce(_at(s, "$.info.license.name"), _at(s, "$.info.license.identifier"), F.when(_at(s, "$.info.license", _MAP).isNull(), _at(s, "$.info.license"))).alias("licence"), _at(s, "$.info.termsOfService").alias("terms"), _at(s, "$.externalDocs.url").alias("documentation"),
            _servers(s).alias("servers"), F.size(operations).cast("long").alias("operations"), F.array_sort(F.array_distinct(media)).alias("media"), F.coalesce(F.array_sort(auth), F.array().cast("array<struct<name:string,kind:string,scheme:string>>")).alias("auth"), F.array_sort(F.array_distinct(F.coalesce(needs, none))).alias("needs"),
            F.when(F.exists(F.coalesce(F.map_keys(_at(s, "$.paths", _MAP)), none), lambda p: p.rlike(r"(?i)(^|/)graphql(/|$)")), "graphql").otherwise("rest").alias("style"),
        )

    # The parsed description is bound once, not parsed again for every field.
    return F.when(_at(spec, "$", _MAP).isNotNull(), F.get(F.transform(F.array(spec), of), F.lit(0)))


def api_operations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, path, method, headline): one row per operation, placed from 1 by path and method; headline is its summary, else its
    operationId, cut to 80 characters. Texts that are no description give no rows."""
    rows = docs.select(F.col(key).alias("key"), F.array_sort(F.transform(_operations(F.try_parse_json(text)), lambda o: F.struct(o.path.alias("path"), o.method.alias("method"), F.substring(F.coalesce(_at(o.op, "$.summary"), _at(o.op, "$.operationId"), F.lit("")), 1, 80).alias("headline")))).alias("ops"))
    return rows.select("key", F.posexplode("ops").alias("p", "o")).select("key", (F.col("p") + 1).alias("place"), "o.path", "o.method", "o.headline")
