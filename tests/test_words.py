import __spark_entry__ as entry


def test_all_words_sees_a_difference_behind_the_third_word(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta gamma delta", 22), (2, "alpha beta gamma epsilon", 24), (3, "", 0), (4, None, None)], "doc_id long, text string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    first = {r["doc_id"]: r["first_words"] for r in entry.queries()["first_words"](spark, str(tmp_path)).collect()}
    got = {r["doc_id"]: r for r in entry.queries()["all_words"](spark, str(tmp_path)).collect()}
    assert first[1] == first[2] and got[1]["words_sha"] != got[2]["words_sha"]
    assert {k: r["n"] for k, r in got.items()} == {1: 4, 2: 4, 3: 0}
