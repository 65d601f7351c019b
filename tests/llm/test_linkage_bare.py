import pytest

from sparkloom.llm.linkage import candidate_pairs


@pytest.mark.parametrize("size", [12, 1100])
def test_listings_without_offering_meet_all_that_share_a_word(spark, size):
    rows = [("x", "one", None, ["atlas", "weather"]), ("y", "two", None, ["weather", "zebra"]), ("z", "two", "tide-tables", ["weather", "yak"]), ("e", "one", None, ["acme"]), ("g", "two", None, ["acme"])]
    rows += [(f"f{i}", "one", None, [f"m{i:05}"]) for i in range(size)]
    f = spark.createDataFrame([(i, s, "acme", o, ["acme"], w, None, []) for i, s, o, w in rows], "id string, source string, site string, offering string, provider_words array<string>, name_words array<string>, provider string, own_words array<string>")
    got = {tuple(r) for r in candidate_pairs(f).collect()}
    assert {("x", "y"), ("x", "z"), ("e", "g")} <= got and ("y", "z") not in got
