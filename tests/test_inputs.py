import __spark_entry__ as entry


def test_texts_and_shas_tell_whole_bodies_apart(spark, tmp_path):
    body = "b" * 9000
    changed = {"same": body, "at300": body[:300] + "x" + body[301:], "at2000": body[:2000] + "x" + body[2001:], "none": None}
    df = spark.createDataFrame([(i, k, "n", "d", "c", v) for i, (k, v) in enumerate(changed.items())], "row_id long, id string, name string, description string, category string, body_markdown string")
    df.selectExpr("*", "timestamp'2026-01-01' AS scraped_at").write.parquet(f"{tmp_path}/skills.parquet")
    got = {r["id"]: r for r in entry.queries()["embedding_records"](spark, str(tmp_path)).collect()}
    assert got["same"]["input"] == "n\n\nd\n\nc\n\n" + body[:1500] and got["none"]["input"] == "n\n\nd\n\nc"
    assert got["at300"]["input"] != got["same"]["input"] == got["at2000"]["input"]
    assert len({r["sha"] for r in got.values()}) == 4
