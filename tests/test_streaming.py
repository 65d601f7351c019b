from pyspark.sql import functions as F

from sparkloom.operators.sessions import gap_sessions as batch_sessions
from sparkloom.sources.sinks import upsert
from sparkloom.streaming import jobs


def log(spark, tmp_path, rows, name):
    df = spark.createDataFrame(rows, "id long, user string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return df


def rows(n=40):
    return [(i, f"u{i % 3}", f"2026-01-0{1 + i // 20} 00:{i % 20:02}:00") for i in range(n)]


def test_days_sessions_and_resumption_equal_the_batch(spark, tmp_path):
    df = log(spark, tmp_path, rows(), "in")
    late = [(100, "u9", "2026-02-01 00:00:00")]  # moves the watermark past everything before
    src = lambda: jobs.read_log(spark, str(tmp_path / "in"), df.schema)
    run = lambda: jobs.run_available(jobs.day_counts(src(), "t", "user"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    log(spark, tmp_path, late, "in")
    run()
    run()
    got = {(str(r["day"]), r["user"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(str(r["d"]), r["user"]): r["n"] for r in df.groupBy(F.to_date("t").alias("d"), "user").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
    jobs.run_available(jobs.gap_sessions(src(), "t", "user", "4 minutes"), str(tmp_path / "s"), str(tmp_path / "scp")).awaitTermination()
    s = {(r["user"], r["start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert s == {(r["user"], r["start"], r["n"]) for r in batch_sessions(df, "user", "t", "4 minutes").collect()}


def test_minute_excess_sliding_and_repeats(spark, tmp_path):
    many = [(i, "busy", f"2026-01-01 00:00:{i:02}") for i in range(40)] + [(i, "busy", f"2026-01-01 00:00:{i:02}") for i in range(5)] + [(99, "other", "2026-01-01 09:00:00")]
    df = log(spark, tmp_path, many, "in")
    src = lambda: jobs.read_log(spark, str(tmp_path / "in"), df.schema)
    for name, stream in {"m": jobs.minute_excess(src(), "t", "user", 30), "r": jobs.without_repeats(src(), "t", ["id"]), "w": jobs.sliding_counts(src(), "t", "user", "2 hours", "1 hour")}.items():
        jobs.run_available(stream, str(tmp_path / name), str(tmp_path / (name + "cp"))).awaitTermination()
    assert [(r["user"], r["n"], r["rejected"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("busy", 45, 15)]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 41
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "w")).where("user = 'busy'").collect()) == [45, 45]


def test_merge_keeps_the_latest_row_of_each_key(spark, tmp_path):
    df = log(spark, tmp_path, [(1, "old", "2026-01-01 00:00:00"), (1, "new", "2026-01-02 00:00:00"), (2, "x", "2026-01-01 00:00:00")], "in")
    state = {"rows": df.where("false")}

    def merge(batch, number):
        kept = upsert(spark.createDataFrame(state["rows"].collect(), df.schema), batch, ["id"], [F.col("t")])
        state["rows"] = spark.createDataFrame(kept.select(*df.columns).collect(), df.schema)

    jobs.merge_available(jobs.read_log(spark, str(tmp_path / "in"), df.schema), merge, str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["user"]) for r in state["rows"].collect()} == {(1, "new"), (2, "x")}
