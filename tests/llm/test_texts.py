import random
from pathlib import Path

import pytest

from sparkloom.llm import leakage, reading
from sparkloom.llm.leakage import leaked_passages, variants
from sparkloom.llm.mixing import TOKENIZER_DIR, count_tokens, mix_sources, rake
from sparkloom.llm.reading import _prose, reading_levels

DOCS = "doc_id long, text string, lang string, source string, doc_kind string, item_id long, tokens long, key string"
needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER_DIR).exists(), reason="no tokenizer files")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, k, 1, 2, "x") for i, t, l, s, k in rows], DOCS)


def text(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = {i: text(rng, rng.choice([5, 12, 40, 90])) for i in range(30)}
    rows = []
    for d in range(200):
        w = text(rng, 120)
        if d % 2:
            it = items[rng.randrange(30)]
            n = rng.choice([11, 12, 20, 60])
            a = rng.randrange(max(1, len(it) - n + 1))
            cut = it[a : a + n]
            if d % 5 == 0 and len(cut) > 20:
                cut[10] = "changed"
            w[30:30] = cut
        sep = rng.choice([" ", "\n> ", " – ", ", "])
        rows.append((d, sep.join(x.upper() if d % 3 == 0 else x for x in w), "en", "s", "k"))
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, " ".join(items[3]), None, None, None), (502, " ".join(text(rng, 50_000) + items[7] + text(rng, 10)), None, None, None)]
    item_df = spark.createDataFrame([(i, " ".join(w), "clash") for i, w in items.items()] + [(None, "x " * 20, ""), (99, None, "")], "item_id long, text string, doc_id string")
    got = {(r["item_id"], r["doc_id"]) for r in leaked_passages(item_df, docs(spark, rows)).where("run >= 12").collect()}
    runs = {tuple(w[a : a + 12]): i for i, w in items.items() for a in range(len(w) - 11)}
    want = set()
    for d, t, *_ in rows:
        w = [x.lower() for x in leakage.WORD.findall(t or "")]
        want |= {(runs[tuple(w[a : a + 12])], d) for a in range(len(w) - 11) if d is not None and tuple(w[a : a + 12]) in runs}
    assert got == want


def test_substitutions_do_not_end_an_overlap(spark):
    w = [f"a{i}" for i in range(40)]
    x = list(w)
    x[5] = x[17] = x[29] = "other"
    out = leaked_passages(spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"), docs(spark, [(1, " ".join(x), None, None, None)])).first()
    assert (out["span"], out["matched"], out["substituted"], out["run"]) == (40, 37, 3, 11)


def test_markup_does_not_matter():
    plain = "the quick brown fox jumps over it".split()
    for t in ("The <b>quick</b> brown&nbsp;fox jumps <i class='x'>over</i> it", "The [quick](http://a.example/b_(c)) brown fox[^1] jumps over it", "The qu­ick brown fox jumps over it", '"The quick\\nbrown fox jumps over it"', "The quick<br/>brown fox jumps over it", "the quick brown [fox][2] jumps over it"):
        assert any([w for w in v if not w.isdigit()] == plain for v in variants(t)), t


def test_leak_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leakage, "FILTER_BITS", 2**15)
    monkeypatch.setattr(leakage, "WINDOW_BITS", 1)
    w = [" ".join(f"b{k}_{i}".replace("_", "x") for i in range(14)) for k in range(4)]
    items = spark.createDataFrame(list(enumerate(w)), "item_id long, text string")
    d = docs(spark, [(k, t, None, None, None) for k, t in enumerate(w)])
    assert {(r["item_id"], r["doc_id"]) for r in leaked_passages(items, d).collect()} == {(k, k) for k in range(4)}
    assert leaked_passages(items.where("false"), d).count() == 0 and leaked_passages(items, d.where("false")).count() == 0


@needs_tokenizer
def test_mixture_reaches_the_weights_and_marks_short_sources(spark):
    rng = random.Random(2)
    size = {"big": 3000, "mid": 1500, "small": 150}
    rows = [((n + 1) * 10_000 + i, " ".join(text(rng, rng.randrange(5, 30))), rng.choice(["en", "EN", "fr", None]), s, rng.choice(["a", "b", None])) for n, (s, c) in enumerate(size.items()) for i in range(c)]
    rows += [(1, None, "en", "big", "a"), (2, "", "en", "big", "a"), (3, "no source", "en", None, "a"), (4, "other source " * 5, "en", "other", "a"), (None, "no id", "en", "big", "a")]
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 2), ("small", 0.2, 3), ("absent", 0.0, 5), (None, 0.1, 1), ("null", None, None)], "source string, weight double, max_repeats int")
    mix = mix_sources(docs(spark, rows), targets)
    s = {r["source"]: r for r in mix.sources.collect()}
    assert {k for k, r in s.items() if r["short"]} == {"small"}
    assert abs(s["big"]["reached_share"] - 0.3) < 0.02 and abs(s["mid"]["reached_share"] - 0.5) < 0.02 and abs(s["big"]["aimed_share"] - 0.3) < 1e-6
    assert s["small"]["most_copies"] == 3 and s["mid"]["most_copies"] <= 2 and s["absent"]["reached_tokens"] == 0
    assert s["small"]["reached_tokens"] == 3 * s["small"]["tokens"]
    copies = {r["doc_id"]: r["copies"] for r in mix.documents.collect()}
    assert not {1, 2, 3, 4, None} & set(copies)


@needs_tokenizer
def test_mixture_of_empty_tables_and_token_counts(spark):
    d = docs(spark, [])
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    out = mix_sources(d, targets)
    assert out.documents.count() == 0 and out.sources.first()["reached_tokens"] == 0
    n = count_tokens(docs(spark, [(1, "hello world", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, "x " * 100_000, None, None, None)]), "text", ["doc_id"])
    assert [r["tokens"] for r in n.orderBy("doc_id").collect()][:3] == [2, 0, 0]


def test_raking_fits_all_marginals_where_it_can():
    import numpy as np
    import pandas as pd

    cells = pd.DataFrame([(s, l, 100.0) for s in "ab" for l in "xy"], columns=["source", "lang", "tokens"])
    w = rake(cells, {"source": {"a": 0.75, "b": 0.25}, "lang": {"x": 0.6, "y": 0.4}}, np.full(4, 9.0), 400.0)
    t = cells.assign(u=w * 100)
    assert np.allclose(t.groupby("source")["u"].sum(), [300, 100]) and np.allclose(t.groupby("lang")["u"].sum(), [240, 160], atol=1e-3)
    capped = rake(cells, {"source": {"a": 0.75, "b": 0.25}, "lang": {"x": 0.6, "y": 0.4}}, np.full(4, 1.0), 400.0)
    assert capped.max() <= 1 and np.isclose((capped * 100)[:2].sum(), 200)


EASY, HARD = ["We read the new map.", "The team has a red box.", "You can see all the tags here."], ["Notwithstanding the antecedent jurisdictional contingencies of the prevailing methodologies, heterogeneous interdependencies systematically problematize whatever obligations remain irreconcilable with respect to the underlying specifications of institutional authorizations.", "Contrary to the hypothetical stipulations of distributional covariances, those irregularities which necessarily presuppose orthogonal taxonomies circumscribe the underlying probabilistic formalizations of extraneous postconditions."]


def test_reading_levels(spark):
    rng = random.Random(0)
    easy = lambda n: " ".join(rng.choice(EASY) for _ in range(n))
    rows = [(i, easy(20), "en", "s", "k") for i in range(60)] + [(100 + i, " ".join(HARD), "EN", "s", "k") for i in range(8)]
    rows += [(200, easy(12) + " " + HARD[0], "en", "s", "k"), (201, easy(6) + "\n\n```\n" + HARD[0] * 5 + "\n```\n", "en", "s", "k"), (202, "# Title\n\n- " + "\n- ".join(HARD), None, "s", "k"), (203, None, "en", "s", "k"), (204, "", "en", "s", "k"), (205, "```\nonly code\n```", "en", "s", "k"), (206, easy(20_000), "und", "s", "k"), (207, easy(9) + "\n\nSee also: jurisdictional contingencies, irreconcilable methodologies, covariances", "en", "s", "k")]
    samples = spark.createDataFrame([(1, 1, "en", easy(12)), (2, 1, "en", easy(9)), (3, 4, "en", " ".join(HARD)), (4, 4, "en", HARD[0]), (5, None, "en", "x y z"), (6, 4, "en", None)], "sample_id long, reading_level long, lang string, text string")
    out = {r["doc_id"]: r["level"] for r in reading_levels(docs(spark, rows), samples).collect()}
    assert {d for d, l in out.items() if l >= 4} == set(range(100, 108)) | {202}
    assert not {203, 204, 205} & set(out) and 206 in out
    assert reading_levels(docs(spark, rows), samples.where("false")).count() == 0
    assert reading_levels(docs(spark, []), samples).count() == 0


def test_prose_leaves_out_what_is_none():
    t = "# Heading one two three\n\nFirst sentence is here. Second one\nis here too!\n\n| a | b |\n|---|---|\n- item with [a link](http://x.example/y) in it\n`code` and more words\nhttps://x.example/a\n"
    assert _prose(t).split("\n") == ["first sentence is here", "second one is here too", "item with a link in it code and more words"] or _prose(t).split("\n")[:3] == ["first sentence is here", "second one is here too", "item with a link in it"]
    assert reading.COVERED == 0.7


def test_raking_in_spark_equals_raking_on_the_driver(spark):
    import numpy as np
    import pandas as pd

    from sparkloom.llm.mixing import rake_cells

    rng = np.random.default_rng(4)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(50, 900))) for s in "abc" for l in "xyz" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    ceiling = cells["source"].map({"a": 1.0, "b": 2.0, "c": 5.0}).to_numpy()
    total, goals = 9000.0, {"source": {"a": 0.6, "b": 0.25, "c": 0.15}, "lang": {"x": 0.5, "y": 0.3, "z": 0.2}, "topic": {"p": 0.5, "q": 0.5}}
    want = rake(cells, goals, ceiling, total, rounds=3)
    tables = {c: spark.createDataFrame([(v, w * total) for v, w in g.items()], f"{c} string, goal double") for c, g in goals.items()}
    got = rake_cells(spark.createDataFrame(cells.assign(ceiling=ceiling)), tables, rounds=3).toPandas()
    got = cells.merge(got, on=["source", "lang", "topic"])["weight"].to_numpy()
    assert np.allclose(got, want, atol=1e-6)


@needs_tokenizer
def test_short_sources_come_from_the_fitted_weights(spark, monkeypatch):
    import numpy as np

    from sparkloom.llm import mixing

    rows = [(i, "some words here " * (1 + i % 3), "en", "a" if i % 4 else "b", "t") for i in range(80)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2)], "source string, weight double, max_repeats int")
    short = lambda: {r["source"] for r in mix_sources(docs(spark, rows), targets).sources.where("short").collect()}
    assert short() == {"b"} == {r["source"] for r in mix_sources(docs(spark, rows), targets, driver_cells=0).sources.where("short").collect()}
    monkeypatch.setattr(mixing, "rake", lambda cells, *_: np.zeros(len(cells)))
    assert short() == {"a", "b"}


def test_a_full_filter_and_shared_windows_lose_nothing(spark, monkeypatch):
    """Many items share one passage, the filter is full (everything passes), and texts say the same words over and over."""
    from sparkloom.llm.leakage import window_filter

    monkeypatch.setattr(leakage, "window_filter", lambda seeds, bits: window_filter(seeds, bits) | 255)
    shared = " ".join(f"s{i}x" for i in range(20))
    items = spark.createDataFrame([(i, f"{shared} own{i}x tail") for i in range(40)] + [(50, "la " * 30)], "item_id long, text string")
    d = docs(spark, [(1, "before " + shared + " after", None, None, None), (2, "la " * 200, None, None, None), (3, "other " * 5 + " ".join(f"t{i}x" for i in range(40)), None, None, None), (1, "before " + shared, None, None, None)])
    rows = leaked_passages(items, d).collect()
    assert {(r["item_id"], r["doc_id"]) for r in rows} == {(i, 1) for i in range(40)} | {(50, 2)} and len(rows) == 41
    assert {r["run"] for r in rows if r["doc_id"] == 1} == {20} and {r["run"] for r in rows if r["doc_id"] == 2} == {30}


def brute_measures(texts, covered=0.7):
    """coverage and sentence ranks from the definition, one language."""
    import math
    from collections import Counter

    counts = Counter(w for t in texts for w in t.replace("\n", " ").split())
    rank = {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    cover = lambda ws: sorted(rank[w] for w in ws)[math.ceil(covered * len(ws)) - 1]
    out = []
    for t in texts:
        each = sorted(cover(s.split()) for s in t.split("\n"))
        out.append((cover(t.replace("\n", " ").split()), (each[(len(each) - 1) // 2] + each[len(each) // 2]) / 2))
    return out


def test_ranks_beyond_the_head_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(chr(97 + rng.randrange(26)) for _ in range(6))
    texts = ["\n".join(" ".join(word() if rng.random() < rare else rng.choice(["the", "of", "and", "map", "box"]) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 6))) for rare in [0.05, 0.2, 0.5, 0.9] * 40]
    monkeypatch.setattr(reading, "HEAD_WORDS", 20)
    prose = spark.createDataFrame([(str(i), "en", t) for i, t in enumerate(texts)] * 2, "key string, lang string, prose string")
    vocabulary = reading.Vocabulary(reading.ranked_vocabulary(prose.dropDuplicates(["key"])))
    assert vocabulary.longest > vocabulary.head == 20
    got = {(int(r["key"]), r["coverage_rank"], r["sentence_rank"]) for r in reading.measured(prose, vocabulary).collect()}
    assert got == {(i, *m) for i, m in enumerate(brute_measures(texts))}


def test_small_languages_have_a_vocabulary_and_wrong_labels_do_not_make_one(spark):
    rng = random.Random(6)
    say = lambda c, n: " ".join(f"{c}{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[min(9, int(rng.expovariate(0.4)))]}" for _ in range(n))
    rows = [(str(i), "en", say("e", 40)) for i in range(398)] + [("s1", "sm", say("s", 40)), ("s2", "sm", say("s", 40)), ("wrong", "zz", say("e", 40)), ("none", None, say("s", 20))]
    prose = spark.createDataFrame(rows, "key string, lang string, prose string")
    out = {r["key"]: r["lang"] for r in reading.measured(prose, reading.Vocabulary(reading.ranked_vocabulary(prose))).collect()}
    assert out["s1"] == out["s2"] == out["none"] == "sm" and out["wrong"] == "en" and out["7"] == "en"
