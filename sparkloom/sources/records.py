"""Record files: one JSON object a line, with an optional header line; JSON arrays; snapshot folders; keyed merges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import changed_rows
from ..operators.reports import expectations
from ..runtime import exists

CURRENT_VERSION = 2
HEADER = "_header boolean, schema_version int, entity_type string, generated_at string"
ORIGIN = "struct<kind:string,source:string,source_id:string,source_url:string,also_listed_in:array<string>>"
#: Columns that all record types share.
COMMON = (
    f"id string, slug string, schema_version int, entity_type string, name string, description string, origin {ORIGIN}, home_url string, docs_url string, repo_full_name string, repo_url string, repo_stars bigint, repo_forks bigint, repo_open_issues bigint, "
    "repo_license string, repo_pushed_at string, repo_archived boolean, quality_score bigint, quality_tier string, novelty_score double, is_duplicate boolean, canonical_slug string, tags array<string>, category string, content_sha string, scraped_at string"
)
#: What single types have besides.
EXTRA = {
    "skill": "struct<body_markdown:string,body_length:bigint,skill_path:string>",
    "plugin": "struct<plugin_path:string,commands:array<string>,hooks:array<string>,bundled_skills:array<string>,manifest_completeness:double>",
    "mcp_server": "struct<server_path:string,transport:string,tools:array<string>,manifest_completeness:double>",
    "api": "struct<base_urls:array<string>,spec_url:string,spec_version:string,endpoint_count:bigint,categories_src:array<string>,provider:string,source_modified_at:string>",
    "dataset": "struct<download_urls:array<string>,size_bytes:bigint,update_frequency:string,publisher:string>",
}


def schema_of(entity_type: str) -> T.StructType:
    """Explicit schema of a record file; open manifests are never inferred."""
    return T.StructType.fromDDL(f"{COMMON}, extra {EXTRA[entity_type]}")


def read_records(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """Rows of a record file or folder: header and malformed lines and rows without a key are skipped, of a key the last line wins.

    Lines come in the order of their files by path, then within a file; what ``append_records`` adds comes later. ``position`` is the
    place (file, split, line) of the key's first occurrence. A missing path gives no rows.
    """
    if not exists(spark, path):
        none = T.StructType([T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("line", T.LongType())])
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("position", none)]))
    full = T.StructType([*schema.fields, T.StructField("_header", T.BooleanType()), T.StructField("_bad", T.StringType())])
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", place.alias("_line"))
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "_line").where("r is not null and r._bad is null and not coalesce(r._header, false)")
    rows = rows.select("r.*", "_line").drop("_header", "_bad").where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rest = [c for c in rows.columns if c not in (key, "_line")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_line").alias("_row"), F.min("_line").alias("position"))
    return last.select(key, *[F.col("_row")[c].alias(c) for c in rest], "position").select(*schema.fieldNames(), "position")


def verified(spark: SparkSession, path: str, entity_type: str, version: int, required: list[str], arrays: list[str], line_limit: int = 25_000_000) -> DataFrame:
    """(rule, broken) of a record file read back line by line: exactly one header, its version and type, no malformed line, no line above
    ``line_limit`` characters, ``arrays`` are arrays and ``required`` members are there in every record."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.try_parse_json("value").alias("v"))
    get = lambda p, kind="string": F.try_variant_get("v", f"$.{p}", kind)
    header = F.coalesce(get("_header", "boolean"), F.lit(False))
    record = F.col("v").isNotNull() & ~header
    checks = {
        "header": F.abs(F.count_if(header) - 1), "schema_version": F.count_if(header & ~get("schema_version", "int").eqNullSafe(F.lit(version))), "entity_type": F.count_if(header & ~get("entity_type").eqNullSafe(F.lit(entity_type))),
        "malformed": F.count_if(F.col("v").isNull()), "line_size": F.count_if(F.length("value") > line_limit),
        **{f"no_array:{c}": F.count_if(record & get(c, "array<variant>").isNull()) for c in arrays}, **{f"missing:{c}": F.count_if(record & get(c).isNull()) for c in required},
    }
    row = lines.agg(*[c.alias(k) for k, c in checks.items()])
    return expectations(row, {k: F.col(f"`{k}`") for k in checks})


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that are one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_snapshots(spark: SparkSession, folder: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Everything below a folder in files, or with ``lines`` in folders of JSON lines, named YYYY-MM-DD.json (with a ``column=`` before it or not), with its date; others are skipped."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:\w+=)?(\d{4}-\d{2}-\d{2})\.json" + ("/[^/]*$" if lines else "$"), 1)
    rows = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(folder)
    return rows.select("*", name.alias("snapshot_date")).where("snapshot_date <> ''").withColumn("snapshot_date", F.to_date("snapshot_date"))


def read_statements(text: str) -> list[str]:
    """SQL statements of a script, comments removed."""
    lines = [line.split("--")[0] for line in text.splitlines()]
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


def run_script(spark: SparkSession, text: str) -> DataFrame:
    """Run the statements of a SQL script in order and return the result of the last."""
    out = None
    for statement in read_statements(text):
        out = spark.sql(statement)
    if out is None:
        raise ValueError("the script has no statement")
    return out


def upcast(df: DataFrame, entity_type: str) -> DataFrame:
    """Rows in the current version: missing origin, home_url and docs_url are filled, lists lose nulls, numbers that are not finite are null.

    Rows of another type pass as they are; a version above the current one is an error.
    """
    feed = entity_type in ("api", "dataset")
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    origin = F.coalesce(
        "origin",
        F.struct(F.lit("manual" if feed else "github").alias("kind"), F.lit("manual" if feed else "github").alias("source"), (F.coalesce("id", "name", F.lit("")) if feed else known("repo_full_name")).alias("source_id"), (known("home_url") if feed else known("repo_url")).alias("source_url"), F.array().cast("array<string>").alias("also_listed_in")),
    )
    version = F.coalesce("schema_version", F.lit(1))
    checked = F.when(version <= CURRENT_VERSION, F.lit(CURRENT_VERSION)).otherwise(F.raise_error(F.concat(F.lit("unknown schema_version "), version.cast("string"))).cast("int"))
    finite = F.when(~F.isnan("novelty_score") & (F.abs("novelty_score") < float("inf")), F.col("novelty_score"))
    defaults = {} if feed else {"repo_stars": F.lit(0), "repo_forks": F.lit(0), "repo_archived": F.lit(False), "repo_url": F.lit("")}
    out = df.withColumn("origin", origin).withColumn("schema_version", checked).withColumn("home_url", F.coalesce("home_url", "repo_url", F.lit("")))
    out = out.withColumn("tags", F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())).withColumn("novelty_score", finite)
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v))
    return out.withColumn("entity_type", F.coalesce("entity_type", F.lit(entity_type)))


def union_types(parts: list[DataFrame]) -> DataFrame:
    """Records of several types in one table; what a type has alone is null in the others."""
    out = parts[0].drop("extra")
    for p in parts[1:]:
        out = out.unionByName(p.drop("extra"), allowMissingColumns=True)
    return out


def record_id(entity_type: Column, repo: Column, path: Column, source: Column, source_id: Column, host: Column, name: Column) -> Column:
    """Id of a record by its type: type:repo/path, api:host/name, dataset:source/id."""
    by_repo = F.concat(entity_type, F.lit(":"), F.concat_ws("/", repo, F.nullif(path, F.lit(""))))
    return F.when(entity_type == "api", F.concat(F.lit("api:"), host, F.lit("/"), name)).when(entity_type == "dataset", F.concat(F.lit("dataset:"), source, F.lit("/"), source_id)).otherwise(by_repo)


def to_refresh(found: DataFrame, stored: DataFrame, key: str = "id", sha: str = "content_sha") -> DataFrame:
    """Rows of ``found`` that are new or whose content changed."""
    return changed_rows(found, stored, key, sha).where("state <> 'unchanged'").drop("state")


#: entity type -> function(spark, path) -> records. New sources register here.
READERS: dict = {}


def reader(entity_type: str):
    def register(f):
        READERS[entity_type] = f
        return f

    return register


for _type in EXTRA:
    READERS[_type] = (lambda t: lambda spark, path: upcast(read_records(spark, path, schema_of(t)), t))(_type)


def first_existing(spark: SparkSession, *paths: str | None) -> str:
    """The first of ``paths`` that exists (null ones are skipped): an override, then the places in order."""
    for p in paths:
        if p and exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(p for p in paths if p) or "no path given")


def draw(number: Column, seed: int) -> Column:
    """A draw of 32 bits for each row number and seed, the same on every machine: products of 32 bits are made in two halves."""
    mask, step = F.lit(2**32 - 1), 1831565813
    times = lambda a, b: (a.bitwiseAND(F.lit(65535)) * b + F.shiftleft(F.shiftright(a, 16) * b.bitwiseAND(F.lit(65535)) % 65536, 16)).bitwiseAND(mask)
    low = lambda x: x.cast("long").bitwiseAND(mask)

    def mixed(t: Column) -> Column:
        u = times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
        return F.get(F.transform(F.transform(F.array(u), lambda u: u.bitwiseXOR(low(u + times(u.bitwiseXOR(F.shiftright(u, 7)), u.bitwiseOR(F.lit(61)))))), lambda v: v.bitwiseXOR(F.shiftright(v, 14))), F.lit(0))

    return F.get(F.transform(F.array(low(number.cast("long") * step + seed + step)), mixed), F.lit(0))


def synthetic_records(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` made-up skill records, the same for the same seed: tiers about 5, 25 and 70 per cent, eight categories in turn."""
    u = lambda k: draw(F.col("id") * 4 + k, seed) / 2**32
    tier = F.when(u(1) < 0.05, "featured").when(u(1) < 0.30, "solid").otherwise("listed")
    score = F.when(u(1) < 0.05, 80 + F.floor(u(2) * 21)).when(u(1) < 0.30, 50 + F.floor(u(2) * 30)).otherwise(F.floor(u(2) * 50))
    repo = F.concat(F.lit("owner"), F.floor(u(3) * F.sqrt(F.lit(n)) + 1).cast("string"), F.lit("/repo"))
    return spark.range(n).select(F.concat(F.lit("skill:"), repo, F.lit("/s"), "id").alias("id"), F.concat(F.lit("s"), "id").alias("name"), repo.alias("repo_full_name"), F.lit("skill").alias("entity_type"), tier.alias("quality_tier"), score.cast("long").alias("quality_score"), F.floor(u(4) * u(4) * 5000).cast("long").alias("repo_stars"), F.concat(F.lit("category-"), F.col("id") % 8).alias("category"), F.lit(CURRENT_VERSION).alias("schema_version"))


def plugins_of(repositories: DataFrame) -> DataFrame:
    """Plugin records of repositories (repo_full_name, description, manifest map, listings array<struct<path,name>>): those with a manifest or a listing.

    Name and description come from the manifest, else from the repository.
    """
    has = (F.coalesce(F.size("manifest"), F.lit(0)) > 0) | (F.coalesce(F.size("listings"), F.lit(0)) > 0)
    of = lambda k: F.nullif(F.try_element_at("manifest", F.lit(k)), F.lit(""))
    return repositories.where(F.col("repo_full_name").isNotNull() & has).select(
        F.concat(F.lit("plugin:"), "repo_full_name").alias("id"), F.lit("plugin").alias("entity_type"), F.coalesce(of("name"), F.element_at(F.split("repo_full_name", "/"), -1)).alias("name"), F.coalesce(of("description"), "description").alias("description"),
        "repo_full_name", F.coalesce(F.size("listings"), F.lit(0)).alias("listed"),
    )


def servers_of(components: DataFrame) -> DataFrame:
    """One server record per mcp component of a repository (id, folder, component), see ``explode_components``."""
    return components.where("folder = 'mcp'").select(F.concat(F.lit("mcp_server:"), "id", F.lit("/"), "component").alias("id"), F.lit("mcp_server").alias("entity_type"), F.regexp_replace("component", r"\.json$", "").alias("name"), F.col("id").alias("repo_full_name"))


def pulse_rows(repositories: DataFrame, date: str) -> DataFrame:
    """Slim snapshot (snapshot_date, repo_full_name, s, f, i, p) of repositories that are neither archived nor forks, each once."""
    live = repositories.where(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("fork", F.lit(False)) & F.col("repo_full_name").isNotNull())
    return live.groupBy("repo_full_name").agg(F.max("stars").alias("s"), F.max("forks").alias("f"), F.max("open_issues").alias("i"), F.max("pushed_at").alias("p")).select(F.lit(date).cast("date").alias("snapshot_date"), "repo_full_name", "s", "f", "i", "p")
