from pyspark.sql import functions as F

from sparkloom.functions import access, entities, rules, scoring
from sparkloom.sources import records
from sparkloom.sources.documents import explode_components


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_packs_name_the_first_failing_gate(spark):
    arrays = "array<string>"
    df = spark.createDataFrame([("x" * 60, {"a": "b"}, None, ["c"]), ("short", {"a": "b"}, None, ["c"]), ("x" * 60, {}, [], ["c"]), ("x" * 60, None, ["l"], None), (None, None, None, None)], f"d string, m map<string,string>, l {arrays}, c {arrays}")
    got = [r[0] for r in df.select(rules.first_reason(entities.plugin_gates(F.col("d"), F.col("m"), F.col("l"), [F.col("c")]))).collect()]
    assert got == [None, "short_description", "no_manifest", "no_components", "short_description"]
    s = rules.first_reason(entities.server_gates(F.lit("x" * 60), F.lit(None).cast("string"), F.array(F.lit("t"))))
    d = rules.first_reason(entities.dataset_gates(F.lit("x" * 60), F.lit("")))
    assert (one(spark, s), one(spark, d)) == ("no_transport", "no_home")


def test_inputs_scores_and_small_tests(spark):
    i = entities.EMBEDDING_INPUTS
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, i["skill"](lit("n"), lit(""), lit(None), lit("b" * 9000))) == "n\n\n" + "b" * 1500
    assert one(spark, i["mcp_server"](lit("n"), lit(None), lit(None), F.array(F.lit("a"), F.lit("b")))) == "n |  | transport=null | tools: a, b"
    assert one(spark, i["dataset"](lit("n"), lit("p"), lit("d"), F.array(F.lit("category:x")), F.array(F.lit("csv")))) == "n | p | d | x | csv"
    assert len(one(spark, i["api"](lit("n" * 400), lit("p"), lit("d"), F.array(F.lit("c"))))) == 300 and one(spark, i["plugin"](lit("n"), lit("d"), F.array(F.lit("k"))))== "n | d | k"
    t = entities.total_score(F.lit("plugin"), {"plugin": {k: F.lit(100) for k in scoring.RECORD_WEIGHTS}})
    assert one(spark, t) == 100 and one(spark, entities.total_score(F.lit("other"), {"plugin": {"stars": F.lit(1), **{k: F.lit(1) for k in scoring.RECORD_WEIGHTS}}})) == 0
    assert [one(spark, entities.in_eea(lit(c))) for c in ("FR", "GB", "fr", "US", None)] == [True, True, False, False, False]
    assert [one(spark, entities.valid_slug(lit(c))) for c in ("a/b", "a/../b", "/a", "a\\b", "", None)] == [True, False, False, False, False, False]
    assert [one(spark, entities.needs_walk(lit(w), lit(p))) for w, p in ((None, None), ("2", None), ("2", "3"), ("3", "2"))] == [True, False, True, False]
    assert one(spark, entities.listed(lit("a"), ["a"])) and not one(spark, entities.listed(lit(None), ["a"])) and not one(spark, entities.listed(lit("a"), []))


def test_access_findings_and_labels(spark):
    a = access
    f = a.best(a.found(F.lit("x"), "list_auth"), a.found(F.lit("y"), "spec_auth"), a.found(F.lit("unknown"), "spec_license"))
    assert (one(spark, f)["value"], one(spark, f)["confidence"]) == ("y", 0.9) and one(spark, a.best(a.found(F.lit(None).cast("string"), "list_auth"))) is None
    assert [one(spark, a.confidence(F.lit(x).cast("double"))) for x in (None, float("nan"), -1.0, 0.4, 3.0)] == [1.0, 1.0, 0.0, 0.4, 1.0]
    s = F.array(F.struct(F.lit("k").alias("name"), F.lit("bearer").alias("type")), F.struct(F.lit("o").alias("name"), F.lit("api_key").alias("type")), F.struct(F.lit("z").alias("name"), F.lit("unknown").alias("type")))
    none = F.array().cast("array<string>")
    assert one(spark, a.scheme_of(s, F.array(F.lit("k")))) == "bearer" and one(spark, a.scheme_of(s, none)) == "api_key" and one(spark, a.scheme_of(F.filter(s, lambda x: x["name"] == "z"), none)) == "none"
    assert [one(spark, a.bytes_label(F.lit(n).cast("long"))) for n in (None, 5, 2048, 1572864)] == ["-", "5 B", "2.0 KB", "1.5 MB"]
    assert [one(spark, a.ago(F.lit(x).cast("double"))) for x in (None, 0.5, 3.0, 70.0, 800.0)] == ["unknown", "today", "3d", "2mo", "2y"]


def test_records_from_repositories(spark, tmp_path):
    repos = spark.createDataFrame([("o/a", "d", {"name": "N"}, None), ("o/b", "d", None, None), ("o/c", "d", {}, [("p", "n")]), (None, "d", {"x": "y"}, None)], "repo_full_name string, description string, manifest map<string,string>, listings array<struct<path:string,name:string>>")
    assert {(r["id"], r["name"], r["listed"]) for r in records.plugins_of(repos).collect()} == {("plugin:o/a", "N", 0), ("plugin:o/c", "c", 1)}
    files = spark.createDataFrame([("o/a", ["mcp/one.json", "mcp/two/x", "commands/z"])], "id string, paths array<string>")
    assert {r["id"] for r in records.servers_of(explode_components(files, "id", "paths")).collect()} == {"mcp_server:o/a/one.json", "mcp_server:o/a/two"}
    p = spark.createDataFrame([("o/a", 1, 2, 3, "t", False, False), ("o/a", 5, 2, 3, "t", False, None), ("o/b", 1, 1, 1, "t", True, False), ("o/c", 1, 1, 1, "t", False, True)], "repo_full_name string, stars long, forks long, open_issues long, pushed_at string, archived boolean, fork boolean")
    assert [(str(r["snapshot_date"]), r["repo_full_name"], r["s"]) for r in records.pulse_rows(p, "2026-01-01").collect()] == [("2026-01-01", "o/a", 5)]
    (tmp_path / "b").write_text("")
    assert records.first_existing(spark, None, str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "b")
    s = records.synthetic_records(spark, 2000, 3)
    assert s.exceptAll(records.synthetic_records(spark, 2000, 3)).isEmpty() and s.select("id").distinct().count() == 2000
    share = {r["quality_tier"]: r["count"] / 2000 for r in s.groupBy("quality_tier").count().collect()}
    assert abs(share["featured"] - 0.05) < 0.02 and abs(share["solid"] - 0.25) < 0.04
