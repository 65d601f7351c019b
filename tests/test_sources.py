import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import directories, documents, openapi, records, sinks


def lines(tmp_path, rows, name="r.ndjson"):
    p = tmp_path / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(p)


def test_record_file_last_line_wins_and_bad_lines_are_skipped(spark, tmp_path):
    path = lines(tmp_path, [{"_header": True, "schema_version": 2, "entity_type": "skill"}, {"id": "a", "name": "one"}, "{broken", {"id": "b", "name": "x"}, {"id": "", "name": "no"}, {"name": "no id"}, {"id": "a", "name": "two", "extra": {"body_length": 3}}, ""])
    rows = {r["id"]: r for r in records.read_records(spark, path, records.schema_of("skill")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["name"] == "two" and rows["a"]["extra"]["body_length"] == 3 and rows["a"]["position"] < rows["b"]["position"]
    assert records.read_records(spark, str(tmp_path / "none"), records.schema_of("api")).count() == 0


def test_upcast_fills_defaults_and_rejects_unknown_versions(spark, tmp_path):
    path = lines(tmp_path, [{"id": "a", "repo_full_name": "o/r", "repo_url": "https://f.example/o/r", "tags": ["category:x", None], "novelty_score": None}])
    r = records.READERS["skill"](spark, path).first()
    assert r["origin"]["kind"] == "github" and r["origin"]["source_id"] == "o/r" and r["home_url"] == "https://f.example/o/r" and r["repo_stars"] == 0 and r["tags"] == ["category:x"] and r["schema_version"] == 2
    api = records.READERS["api"](spark, lines(tmp_path, [{"id": "b", "home_url": "https://x.example"}], "b.ndjson")).first()
    assert api["repo_stars"] is None and api["origin"]["source"] == "manual"
    with pytest.raises(Exception, match="unknown schema_version 3"):
        records.READERS["skill"](spark, lines(tmp_path, [{"id": "a", "schema_version": 3}], "c.ndjson")).collect()


def test_arrays_snapshots_statements_union_and_ids(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("2026-01-01.json", "2026-01-02.json", "latest.json"):
        (tmp_path / "s" / name).write_text(json.dumps([{"id": name, "n": 1}]))
    schema = "id string, n long"
    from pyspark.sql.types import StructType

    assert records.read_array(spark, str(tmp_path / "s" / "latest.json"), StructType.fromDDL(schema)).first()["id"] == "latest.json"
    assert sorted(str(r["snapshot_date"]) for r in records.read_snapshots(spark, str(tmp_path / "s"), StructType.fromDDL(schema)).collect()) == ["2026-01-01", "2026-01-02"]
    assert records.read_statements("-- x\nselect 1; -- y\n\nselect 2") == ["select 1", "select 2"]
    skill, api = (records.upcast(spark.createDataFrame([], records.schema_of(t)), t) for t in ("skill", "api"))
    assert "extra" not in records.union_types([skill, api]).columns
    row = spark.createDataFrame([("skill", "o/r", "p/SKILL.md", "s", "i", "h", "n"), ("api", None, None, "s", "i", "h.example", "n"), ("dataset", None, None, "s", "i", "h", "n")], "t string, r string, p string, s string, i string, h string, n string")
    ids = [x[0] for x in row.select(records.record_id(*map(F.col, "trpsihn"))).collect()]
    assert ids == ["skill:o/r/p/SKILL.md", "api:h.example/n", "dataset:s/i"]


def raw(spark, x):
    return spark.createDataFrame([(json.dumps(x),)], "text string")


def test_directories(spark, tmp_path):
    v = {"info": {"title": "T", "description": " d ", "x-providerName": "shop.example", "x-serviceName": "Orders"}, "swaggerUrl": "u", "updated": "2025-01-01", "openapiVer": "3.0.0"}
    listed = {"shop.example:orders": {"preferred": "1", "versions": {"1": v}}, "old.example": {"preferred": "2", "versions": {"1": v}}, "api.example:api": {"preferred": "1", "versions": {"1": {"info": {"x-serviceName": "api"}, "updated": "2020-01-01"}}}}
    a = {r["source_id"]: r for r in directories.parse_map_list(raw(spark, listed), "text", "map").collect()}
    assert set(a) == {"shop.example:orders", "api.example:api"} and a["shop.example:orders"]["name"] == "orders" and a["shop.example:orders"]["description"] == "d" and a["api.example:api"]["name"] == "api" and a["api.example:api"]["source_modified_at"] is None
    page = {"data": [{"title": "API Étude", "slug": "s1", "base_api_url": "b", "owner": {"slug": "me"}}, {"title": "x", "archived_at": "1"}, {"title": "y", "private": True}, None], "next_page": "n"}
    b = directories.parse_pages(raw(spark, page), "text", "portal").collect()
    assert [r["name"] for r in b] == ["etude"] and b[0]["base_urls"] == ["b"] and b[0]["provider"] == "me"
    assert directories.next_page(raw(spark, page), "text").first()[0] == "n"
    c = directories.parse_open_list(raw(spark, {"entries": [{"API": "Cat Facts", "Link": "https://www.cats.example/x", "Category": "Animals"}, {"API": ""}, {"Link": "l"}]}), "text", "open").collect()
    assert len(c) == 1 and c[0]["provider"] == "cats.example" and c[0]["categories_src"] == ["Animals"]
    p = tmp_path / "t.csv"
    p.write_bytes('﻿url,name,description,documentation,provider,dateUpdated\nhttps://g.example/a,Tax ""Info"",".x\nsecond, line",,HM,2025-03-04\n,,,,,\n,No Url,d,https://d.example,,soon\n'.replace('Tax ""Info""', '"Tax ""Info"""').encode())
    d = {r["name"]: r for r in directories.parse_table(directories.read_table(spark, str(p)), "gov").collect()}
    assert set(d) == {"tax-info", "no-url"} and d["tax-info"]["source_modified_at"] == "2025-03-04T00:00:00Z" and "second, line" in d["tax-info"]["description"] and d["no-url"]["home_url"] == "https://d.example" and d["no-url"]["source_modified_at"] is None
    all_ = [directories.parse_pages(raw(spark, page), "text", "portal"), directories.parse_table(directories.read_table(spark, str(p)), "gov")]
    again = directories.harvest(all_, prior=all_[0], least={"gov": 2})
    assert {(r["source"], r["reused"]) for r in again.collect()} == {("portal", True), ("gov", False)}
    with pytest.raises(ValueError, match="gov"):
        directories.harvest(all_, least={"gov": 3})


def test_api_profiles_and_operations_of_both_specifications(spark):
    v3 = {"openapi": "3.0.1", "info": {"title": "T", "license": {"name": "MIT"}}, "servers": [{"url": "https://{r}.x.example/v1", "variables": {"r": {"default": "eu"}}}], "components": {"securitySchemes": {"k": {"type": "apiKey"}}}, "security": [{"k": []}], "paths": {"/a": {"get": {"summary": "s" * 100, "responses": {"200": {"content": {"application/json": {}}}}}, "parameters": []}, "/graphql": {"post": {"operationId": "q"}}}}
    v2 = {"swagger": "2.0", "host": "h.example", "basePath": "/b", "schemes": ["http", "wss"], "produces": ["text/csv"], "paths": {"/x": {"delete": {}}}, "externalDocs": {"url": "d"}}
    rows = spark.createDataFrame([(0, json.dumps(v3)), (1, json.dumps(v2)), (2, "[1]"), (3, "{bad"), (4, None), (5, '{"paths": {"/x": [1], "/y": null}, "servers": "no", "info": 3}'), (6, "{}")], "i int, t string")
    out = {r["i"]: r["d"] for r in rows.select("i", openapi.api_profile(F.col("t")).alias("d")).collect()}
    assert out[0]["servers"] == ["https://eu.x.example/v1"] and out[0]["operations"] == 2 and out[0]["style"] == "graphql" and out[0]["needs"] == ["k"] and out[0]["licence"] == "MIT" and out[0]["auth"][0]["kind"] == "apiKey"
    assert out[1]["servers"] == ["http://h.example/b", "wss://h.example/b"] and out[1]["media"] == ["text/csv"] and out[1]["documentation"] == "d"
    assert out[2] is None and out[3] is None and out[4] is None and out[5]["operations"] == 0 and out[6]["servers"] == []
    ops = [tuple(r) for r in openapi.api_operations(rows, "i", "t").collect()]
    assert ops == [(0, 1, "/a", "get", "s" * 80), (0, 2, "/graphql", "post", "q"), (1, 1, "/x", "delete", "")]


def test_frontmatter_documents(spark):
    rows = [("a/skills/x/SKILL.md", "---\nname: My Skill!\ndescription: Does it\nlist: [1, 2]\n---\n# T\n\nBody"), ("a/tool/SKILL.md", "# Head\n\nFirst line\nsecond\n\nThird"), ("SKILL.md", "---\n: : bad: [\n---\nText here"), ("b/SKILL.md", ""), ("c/SKILL.md", None)]
    out = {r["p"]: r for r in documents.parse_skill_documents(spark.createDataFrame(rows, "p string, t string"), "t", "p").collect()}
    assert set(out) == {"a/skills/x/SKILL.md", "a/tool/SKILL.md", "SKILL.md"}
    assert (out["a/skills/x/SKILL.md"]["name"], out["a/skills/x/SKILL.md"]["description"], out["a/skills/x/SKILL.md"]["front"]["list"]) == ("my-skill", "Does it", "[1, 2]")
    assert (out["a/tool/SKILL.md"]["name"], out["a/tool/SKILL.md"]["description"]) == ("tool", "First line second")
    assert (out["SKILL.md"]["name"], out["SKILL.md"]["description"]) == ("unknown-skill", "Text here")


def test_robots(spark):
    text = "# c\nUser-agent: GPTBot\nUser-agent: Other\nDisallow: /\nAllow: /open\n\nUser-agent: *\nDisallow: /private*\nDisallow: /x$\nSitemap: s\nContent-Signal: ai=no\nnonsense"
    r = documents.read_robots(text)
    assert len(r["groups"]) == 2 and r["sitemaps"] == ["s"] and r["content_signal"] == "ai=no"
    assert not documents.allowed(r, "/a", "gptbot") and documents.allowed(r, "/open/a", "Other") and documents.allowed(r, "/a", "someone") and not documents.allowed(r, "/private/x", "someone") and not documents.allowed(r, "/x", "z") and documents.allowed(r, "/xy", "z")
    rows = spark.createDataFrame([(0, 200, text), (1, 404, None), (2, 500, ""), (3, None, None)], "i int, s int, t string")
    out = {x["i"]: x["p"] for x in rows.select("i", documents.robots_policy(["GPTBot", "CCBot"])("s", "t").alias("p")).collect()}
    assert out[0]["shut_out"] == ["GPTBot"] and out[0]["named"] == ["GPTBot"] and not out[0]["shuts_out_all"]
    assert out[1]["policy"] == "allow_all" and not out[1]["shuts_out_all"] and out[2]["shuts_out_all"] and out[3]["policy"] == "disallow_all"


def test_components_take_the_first_root(spark):
    df = spark.createDataFrame([("r", ["commands/a.md", "plugin/commands/b.md", "plugin/hooks/h/x", "README"])], "id string, paths array<string>")
    assert {tuple(r) for r in documents.explode_components(df, "id", "paths").collect()} == {("r", "commands", "a.md"), ("r", "hooks", "h")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "id string, n int, t string")
    path = str(tmp_path / "out")
    sinks.write_records(df, path, "skill", 2, "2026-01-01")
    sinks.append_records(df.where("id = 'a'").withColumn("n", F.lit(9)), path)
    got = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert sum("_header" in g for g in got) == 1 and len(got) == 5
    with pytest.raises(ValueError):
        sinks.append_records(df.withColumn("_header", F.lit(True)), path)
    todo, state = sinks.publish(df, spark.createDataFrame([("a", "old")], "key string, sha string"), "id", F.to_json(F.struct("n", "t")), [F.col("n")], 2)
    assert [r["key"] for r in todo.orderBy("key").collect()] == ["a", "b"] and state.count() == 2
    again, _ = sinks.publish(df, state, "id", F.to_json(F.struct("n", "t")), [F.col("n")], 5)
    assert [r["key"] for r in again.collect()] == ["c"]
    merged = sinks.upsert(df, df.where("id = 'a'").withColumn("n", F.lit(7)), ["id"], [F.col("n")])
    assert {r["id"]: r["n"] for r in merged.collect()} == {"a": 7, "b": 2, "c": 3}
    items = df.select("id", F.lit("u").alias("url"), F.lit("t").alias("title"), "t", F.lit("d").alias("date_published")).withColumnRenamed("t", "summary")
    doc = json.loads(sinks.feed(items, "T", "h", [F.desc("id")], 2).first()[0])
    assert [i["id"] for i in doc["items"]] == ["c", "b"]
    assert json.loads(sinks.registry(df, ["x", "z"], "t", ["id"], [F.col("id")]).first()[0]) == {"count": 2, "records": [{"id": "a"}, {"id": "c"}]}


def test_delivery_isolates_bad_rows(spark):
    def send(rows):
        if any(r["n"] in (3, 17) for r in rows):
            raise ValueError("bad batch")

    bad = sinks.deliver(spark.range(40).select(F.col("id").alias("n")).coalesce(1), send, 16).collect()
    assert sorted(b["row"] for b in bad) == ["{'n': 17}", "{'n': 3}"]


def test_record_files_are_verified(spark, tmp_path):
    path = lines(tmp_path, [{"_header": True, "schema_version": 1, "entity_type": "skill"}, {"id": "a", "tags": ["x"]}, {"id": "b", "tags": "x"}, "{broken", {"tags": []}, {"_header": True, "schema_version": 2, "entity_type": "api"}])
    got = {r["rule"]: r["broken"] for r in records.verified(spark, path, "skill", 2, ["id"], ["tags"], line_limit=60).collect()}
    assert got == {"header": 1, "schema_version": 1, "entity_type": 1, "malformed": 1, "line_size": 1, "no_array:tags": 1, "missing:id": 1}


def test_what_is_appended_is_read_last(spark, tmp_path):
    path, schema = str(tmp_path / "r"), records.T.StructType.fromDDL("id string, n long")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n long")
    sinks.write_records(df, path, "skill", 2, "2026-01-01")
    for n in (2, 3):
        sinks.append_records(df.where("id = 'a'").withColumn("n", F.lit(n).cast("long")).repartition(3), path)
    assert {(r["id"], r["n"]) for r in records.read_records(spark, path, schema).collect()} == {("a", 3), ("b", 1)}


def test_arrays_scripts_draws_and_loads(spark, tmp_path):
    from sparkloom.runtime import loaded

    sinks.write_arrays(spark.range(25).coalesce(1), str(tmp_path / "arrays"), 10)
    files = [p for p in (tmp_path / "arrays").iterdir() if p.name.startswith("part-")]
    assert len(files) == 3 and sorted(r["id"] for r in records.read_array(spark, str(tmp_path / "arrays"), records.T.StructType.fromDDL("id long")).collect()) == list(range(25))
    with pytest.raises(ValueError):
        records.run_script(spark, "-- nothing")

    def step(n, seed):
        mul = lambda a, b: a * b & 0xFFFFFFFF
        t = n * 1831565813 + seed + 1831565813 & 0xFFFFFFFF
        u = mul(t ^ t >> 15, t | 1)
        v = u ^ (u + mul(u ^ u >> 7, u | 61)) & 0xFFFFFFFF
        return v ^ v >> 14

    assert [r[0] for r in spark.range(50).select(records.draw(F.col("id"), 3)).collect()] == [step(n, 3) for n in range(50)]
    calls = []
    build = lambda: calls.append(1) or spark.range(4)
    assert loaded(spark, str(tmp_path), build).count() == loaded(spark, str(tmp_path), build).count() == 4 and len(calls) == 1
