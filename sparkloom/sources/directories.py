"""Parsers of API directories: map list, portal pages, open list, government table. Each gives the common listing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_accents, host_of, slug

LISTING = ["name", "description", "source", "source_id", "source_url", "home_url", "docs_url", "base_urls", "spec_url", "spec_version", "categories_src", "provider", "source_modified_at", "content_sha"]
_VERSION = "struct<info:struct<title:string,description:string,contact:struct<url:string>,`x-providerName`:string,`x-serviceName`:string,`x-apisguru-categories`:array<string>>,swaggerUrl:string,openapiVer:string,updated:string,externalDocs:struct<url:string>>"
MAP_LIST = f"map<string,struct<added:string,preferred:string,versions:map<string,{_VERSION}>>>"
PAGE = "struct<data:array<struct<title:string,slug:string,id:string,description:string,archived_at:string,deleted_at:string,private:boolean,self_api_url:string,self_web_url:string,technical_documentation_url:string,business_documentation_url:string,base_api_url:string,machine_documentation_url:string,tags:array<string>,organization:struct<slug:string>,owner:struct<slug:string>,metadata_modified_at:string>>,next_page:string>"
OPEN_LIST = "struct<count:bigint,entries:array<struct<API:string,Description:string,Auth:string,HTTPS:boolean,Cors:string,Link:string,Category:string>>>"


def _sha(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _listing(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {"docs_url": F.lit(None).cast("string"), "spec_url": F.lit(None).cast("string"), "spec_version": F.lit(None).cast("string"), "base_urls": F.array().cast("array<string>"), "categories_src": F.array().cast("array<string>"), "source_modified_at": F.lit(None).cast("string")}
    return df.select(*[(columns.get(c, empty.get(c))).alias(c) for c in LISTING])


def parse_map_list(raw: DataFrame, text: str, source: str, frozen_before: str = "2024-01-01") -> DataFrame:
    """Entries of ``{key: {preferred, versions: {version: ...}}}``: the preferred version of each; keys without it are skipped.

    A modification time before ``frozen_before`` says nothing and becomes null. The name is the service where it tells anything, else
    the first label of the provider.
    """
    rows = raw.select(F.explode(F.from_json(text, MAP_LIST)).alias("key", "api")).withColumn("v", F.try_element_at("api.versions", F.col("api.preferred"))).where("v is not null")
    info = F.col("v.info")
    provider = F.coalesce(info["x-providerName"], F.element_at(F.split("key", ":"), 1))
    service = info["x-serviceName"]
    tells = (F.coalesce(service, F.lit("")) != "") & ~F.contains(service, F.lit(".")) & (slug(service) != "api")
    updated = F.col("v.updated")
    return _listing(
        rows, name=slug(fold_accents(F.when(tells, service).otherwise(F.element_at(F.split(provider, r"\."), 1)))), description=_text(info["description"]), source=F.lit(source), source_id=F.col("key"), source_url=F.col("v.swaggerUrl"),
        home_url=F.coalesce(info["contact"]["url"], F.col("v.externalDocs.url"), F.concat(F.lit("https://"), provider, F.lit("/"))), docs_url=F.col("v.externalDocs.url"), spec_url=F.col("v.swaggerUrl"), spec_version=F.col("v.openapiVer"),
        categories_src=F.filter(F.coalesce(info["x-apisguru-categories"], F.array().cast("array<string>")), lambda c: c.isNotNull()), provider=provider, source_modified_at=F.when(updated >= frozen_before, updated), content_sha=_sha(F.col("key"), updated.alias("updated"), F.col("v.swaggerUrl").alias("url")),
    )


def parse_pages(raw: DataFrame, text: str, source: str) -> DataFrame:
    """Items of portal pages ``{data: [...], next_page}``; archived, deleted and private ones are skipped."""
    rows = raw.select(F.explode(F.from_json(text, PAGE)["data"]).alias("i")).where("i is not null and i.archived_at is null and i.deleted_at is null and not coalesce(i.private, false)").select("i.*")
    whole = slug(fold_accents(F.coalesce("title", F.lit(""))))
    short = F.regexp_replace(whole, "^api-", "")
    return _listing(
        rows, name=F.when(short == "", whole).otherwise(short), description=_text(F.col("description")), source=F.lit(source), source_id=F.coalesce("slug", "id"), source_url=F.col("self_api_url"), home_url=F.coalesce("self_web_url", F.lit("")),
        docs_url=F.coalesce("technical_documentation_url", "business_documentation_url"), base_urls=F.array_compact(F.array("base_api_url")), spec_url=F.col("machine_documentation_url"), categories_src=F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()),
        provider=F.coalesce("organization.slug", "owner.slug", F.lit(source)), source_modified_at=F.col("metadata_modified_at"), content_sha=_sha(F.col("slug"), F.col("metadata_modified_at")),
    )


def next_page(raw: DataFrame, text: str) -> DataFrame:
    """(next_page) of each page that has one."""
    return raw.select(F.from_json(text, PAGE)["next_page"].alias("next_page")).where("next_page is not null")


def parse_open_list(raw: DataFrame, text: str, source: str) -> DataFrame:
    """Entries of ``{entries: [{API, Description, Auth, Link, Category}]}``; entries without a name are skipped."""
    rows = raw.select(F.explode(F.from_json(text, OPEN_LIST)["entries"]).alias("e")).where("coalesce(e.API, '') <> ''").select("e.*")
    return _listing(
        rows, name=slug(fold_accents("API")), description=_text(F.col("Description")), source=F.lit(source), source_id=F.col("API"), source_url=F.lit(None).cast("string"), home_url=F.coalesce("Link", F.lit("")), base_urls=F.array_compact(F.array("Link")),
        categories_src=F.array_compact(F.array(F.nullif(F.col("Category"), F.lit("")))), provider=F.coalesce(F.nullif(F.regexp_replace(host_of(F.col("Link")), r"^www\.", ""), F.lit("")), F.lit(source)), content_sha=_sha(F.col("API"), F.col("Link")),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A government table: quoted fields may span lines and double their quotes, a byte order mark is skipped; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", True).csv(path)


def parse_table(rows: DataFrame, source: str) -> DataFrame:
    """Listings of a government table; rows without a name are skipped, dates that are none are null."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.where(F.trim(t("name")) != "")
    return _listing(
        rows, name=slug(fold_accents("name")), description=_text(F.col("description")), source=F.lit(source), source_id=F.coalesce(F.nullif(t("url"), F.lit("")), "name"), source_url=F.lit(None).cast("string"),
        home_url=F.coalesce(F.nullif(t("url"), F.lit("")), "documentation", F.lit("")), docs_url=F.nullif(t("documentation"), F.lit("")), base_urls=F.when(host_of(F.col("url")) != "", F.array("url")).otherwise(F.array().cast("array<string>")),
        provider=F.coalesce(F.nullif(t("provider"), F.lit("")), F.lit(source)), source_modified_at=F.when(t("dateUpdated").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.col("dateUpdated"), F.lit("T00:00:00Z"))), content_sha=_sha(t("url").alias("url"), F.col("name"), t("dateUpdated").alias("updated")),
    )


def harvest(parts: list[DataFrame], prior: DataFrame | None = None, least: dict[str, int] | None = None) -> DataFrame:
    """Union of directories with ``reused``: the content equals a prior row of the same source and id. ``least`` rows per source are required."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if least:
        n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per directory
        short = {s: (n.get(s, 0), m) for s, m in least.items() if n.get(s, 0) < m}
        if short:
            raise ValueError(f"too few listings (found, required): {short}")
    if prior is None:
        return out.withColumn("reused", F.lit(False))
    old = prior.select("source", "source_id", "content_sha").distinct().withColumn("_old", F.lit(True))
    return out.join(old, ["source", "source_id", "content_sha"], "left").withColumn("reused", F.coalesce("_old", F.lit(False))).drop("_old")
