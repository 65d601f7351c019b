"""Problem 3: listings of different sources that mean one API.

Probabilistic record linkage after Fellegi and Sunter: several blocking passes propose pairs, each pair is compared field by field in
agreement levels, expectation-maximisation estimates how often matches and non-matches show each level, and the posterior
probability of a match is the confidence of a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_in_groups
from ..runtime import looked_up, merged, written

#: Second-level labels below which names are registered, path parts that name no offering.
SUFFIXES = "co|com|org|net|gov|gouv|gob|edu|ac|or|go"
NO_OFFERING = ["docs", "doc", "reference", "about", "index", "api", "apis", "home", "en", "fr", "services", "portal"]
#: Next listings by name that each listing of a site is compared with, so that pairs of other offerings are seen too.
NEIGHBOURS = 3
#: Letters at the beginning and the end of a label by which misspelt names of providers are found.
LETTERS = 3
#: Spread of the random pairs over tasks.
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL with or without scheme; empty where there is none."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#@]{0,200}@)?([a-z0-9\-]+(?:\.[a-z0-9\-]+){1,20})(?=[/?#:]|$)", 1)


def site_of(host: Column) -> Column:
    """The registered label of a host without hyphens: docs.nale-jere.co.example -> nalejere."""
    return F.regexp_replace(F.regexp_extract(host, rf"([^.]+)(?:\.(?:{SUFFIXES}))?\.[a-z]+$", 1), "-", "")


def words_of(text: Column) -> Column:
    """Distinct words of ``text``; a joined name is also split where a capital follows a small letter. Null gives no words."""
    spaced = F.concat_ws(" ", text, F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def listing_features(apis: DataFrame) -> DataFrame:
    """One row per listing id (its greatest row_id): source, site, slugs, offering, offering_given, name_words, text_words, words, provider.

    Every field but id and source may be null or empty; listings without id or source are dropped.
    """
    own_id = F.regexp_extract("origin.source_id", r"^([a-z0-9\-]+(?:\.[a-z0-9\-]+){1,20}):", 1)
    named = F.when(F.lower("extra.provider").rlike(r"^[a-z0-9\-]+(\.[a-z0-9\-]+){1,20}$"), F.lower("extra.provider"))
    row = F.struct("name", "description", "home_url", "docs_url", F.col("extra.base_urls").alias("base_urls"), F.col("extra.provider").alias("provider"), F.col("origin.source_id").alias("source_id"), F.col("origin.source_url").alias("source_url"), own_id.alias("id_host"), named.alias("named_host"))
    rows = apis.where(F.col("id").isNotNull() & F.col("origin.source").isNotNull()).groupBy("id", F.col("origin.source").alias("source")).agg(F.max_by(row, "row_id").alias("r")).select("id", "source", "r.*")
    # Each URL is parsed once. Addresses at the directory itself say nothing about a listing's own host.
    urls = F.filter(F.concat(F.array("home_url"), F.coalesce("base_urls", F.array().cast("array<string>")), F.array("docs_url")), lambda u: u.isNotNull())
    rows = rows.withColumn("urls", F.transform(urls, lambda u: F.struct(u.alias("u"), host_of(u).alias("h")))).withColumn("directory", host_of(F.col("source_url")))
    at_home = lambda u: u.h == F.coalesce("directory", F.lit(""))
    rows = rows.withColumn("own", F.filter("urls", lambda u: (u.h != "") & ~at_home(u))).withColumn("listed", F.filter("urls", lambda u: (u.h != "") & at_home(u)))
    site = F.coalesce(site_of(F.get("own", F.lit(0))["h"]), F.when(F.col("id_host") != "", site_of(F.col("id_host"))), site_of(F.col("named_host")))
    parts = F.flatten(F.transform("own", lambda u: F.split(F.regexp_replace(F.lower(u.u), r"^(?:[a-z][a-z0-9+.\-]*://)?[^/?#]*|\?.*$", ""), "[/#?]")))
    slugs = F.filter(parts, lambda s: s.rlike(r"^[a-z]{3,}(-[a-z]+){0,20}$") & ~s.isin(NO_OFFERING))
    tail = F.regexp_extract("source_id", r"^(?:[a-z0-9.\-]+:)?([a-z]+(?:-[a-z]+){0,20}?)(?:-[0-9a-f]{6,})?$", 1)
    tails = F.concat_ws(" ", F.transform("listed", lambda u: F.regexp_extract(u.u, r"/([^/?#]+)/?(?:[?#].*)?$", 1)))
    return rows.select("id", "source", F.when(site != "", site).alias("site"), slugs.alias("slugs"), tail.alias("tail"), "provider", "description", words_of(F.concat_ws(" ", "name", tails)).alias("name_words"), words_of(F.col("description")).alias("text_words"))


def with_offerings(listings: DataFrame) -> DataFrame:
    """Adds offering, offering_given, name_telling and name_meaning: the slug that names a listing's offering in its own URLs or id, or else the one its words speak for.

    Which words speak for which slug, in whatever language, is counted over all listings that have a slug: a word's weight is the
    share of its listings that have the slug. A listing takes the slug with the greatest sum of -log(1 - weight).
    """
    vocabulary = listings.select(F.explode("slugs").alias("slug")).distinct().withColumn("known", F.lit(True))
    tails = listings.where("tail <> ''").select("id", F.col("tail").alias("slug")).join(vocabulary, "slug", "left_semi")
    given = listings.select("id", F.explode("slugs").alias("slug")).unionByName(tails).groupBy("id", "slug").agg(F.count(F.lit(1)).alias("n"))
    given = written(given.groupBy("id").agg(F.max(F.struct("n", "slug")).alias("m")).select("id", F.col("m.slug").alias("offering")), "given")
    base = listings.select("id", "site", F.array_union("name_words", "text_words").alias("words")).join(given, "id", "left")
    taught = base.where("offering is not null").select("site", "offering", F.explode("words").alias("word")).groupBy("word", "offering").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("s"), F.max("site").alias("t"))
    # Words of a single site name its provider, not an offering.
    per_word = taught.groupBy("word").agg(F.sum("n").alias("all"), F.min("s").alias("s"), F.max("t").alias("t")).where("s <> t").select("word", "all")
    spelled = vocabulary.select(F.explode(F.split("slug", "-")).alias("word"), F.col("slug").alias("offering"), F.lit(0.3).alias("w")).where("length(word) >= 3")
    weights = taught.select("word", "offering", "n").join(per_word, "word").select("word", "offering", (F.col("n") / (F.col("all") + 1)).alias("w")).where("w >= 0.2")
    weights = written(weights.unionByName(spelled).groupBy("word", "offering").agg(F.max("w").alias("w")), "weights")
    asked = base.where("offering is null").select("id", F.explode("words").alias("word"))
    score = looked_up(asked, weights, "word").groupBy("id", "offering").agg(F.sum(-F.log(1 - F.col("w") * 0.999)).alias("score"))
    guessed = score.groupBy("id").agg(F.max(F.struct("score", "offering")).alias("m")).where("m.score >= 0.5").select("id", F.col("m.offering").alias("offering"))
    both = given.withColumn("offering_given", F.lit(True)).unionByName(guessed.withColumn("offering_given", F.lit(False)))
    # What the words of a name speak for, so that names in different languages can be compared.
    meant = looked_up(listings.select("id", F.explode("name_words").alias("word")), weights.where("w >= 0.3"), "word").groupBy("id").agg(F.collect_set("word").alias("name_telling"), F.collect_set("offering").alias("name_meaning"))
    none = F.array().cast("array<string>")
    return merged(merged(listings, both, "id", "left"), meant, "id", "left").withColumn("name_telling", F.coalesce("name_telling", none)).withColumn("name_meaning", F.coalesce("name_meaning", none))


#: Share of the listings with a word whose site begins or ends with it, from which on the word names providers.
OWN_SHARE = 0.5


def with_provider_words(listings: DataFrame) -> DataFrame:
    """Adds provider_words: of a listing's words those that name a provider, and, where it has a site, begin or end the label of its own;
    and own_words: of the name of a listing without a site, in order, the words that listings of several sites do not share.

    A word names a provider if most listings that use it belong to sites that begin or end with it; counted over all listings with
    a site, so that common words that happen to begin or end a label (map, date) do not count.
    """
    words = F.array_distinct(F.concat("name_words", "text_words", words_of(F.col("provider"))))
    rows = listings.withColumn("words", words)
    each = rows.select("id", "site", F.explode("words").alias("word")).where("length(word) >= 3")
    own = F.startswith("site", F.col("word")) | F.endswith("site", F.col("word"))
    used = each.where("site is not null").groupBy("word").agg(F.count_if(own).alias("own"), F.count(F.lit(1)).alias("n"), F.min("site").alias("s"), F.max("site").alias("t"))
    used = written(used.select("word", ((F.col("own") > 0) & (F.col("own") >= OWN_SHARE * F.col("n"))).alias("names"), (F.col("s") != F.col("t")).alias("shared")), "words")
    names = used.where("names").select("word")
    alone = rows.where("site is null").select("id", F.posexplode("name_words").alias("place", "word")).where("length(word) >= 3")
    alone = looked_up(alone, used.where("shared and not names").select("word"), "word", "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word).alias("own_words"))
    hits = looked_up(each.where(F.col("site").isNull() | own), names, "word").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("provider_words"))
    none = F.array().cast("array<string>")
    return merged(merged(rows, hits, "id", "left"), alone, "id", "left").withColumn("provider_words", F.coalesce("provider_words", none)).withColumn("own_words", F.coalesce("own_words", none))


def candidate_pairs(f: DataFrame) -> DataFrame:
    """(a, b), a < b, of different sources, from all blocking passes: same site and offering; same offering and a provider word where one
    has no site; same offering and the first or last letters of a provider's name where one has no site, for misspelt names and codes;
    same site and a shared word of the name where one has no offering; the next listings by name within a site.

    Provider words are no shared words of a name; a name of nothing else is compared with those of its site that have nothing else either.
    Every pass is an equality join, so no block is cut, whatever its size.
    """

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        l, r = left.select(F.col("id").alias("l"), F.col("source").alias("ls"), *keys), right.select(F.col("id").alias("r"), F.col("source").alias("rs"), *keys)
        return merged(l, r, keys).where("l <> r and ls <> rs").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))

    placed = f.where("site is not null and offering is not null")
    first = joined(placed, placed, ["site", "offering"])
    spoken = f.where("offering is not null").withColumn("word", F.explode("provider_words"))
    second = joined(spoken.where("site is null"), spoken, ["offering", "word"])
    ends = lambda w: F.array(F.concat(F.lit("^"), F.substring(w, 1, LETTERS)), F.concat(F.right(w, F.lit(LETTERS)), F.lit("$")))
    names = F.filter(F.array_union("own_words", words_of(F.col("provider"))), lambda w: F.length(w) >= LETTERS)
    homeless = f.where("offering is not null and site is null").withColumn("part", F.explode(F.array_distinct(F.flatten(F.transform(names, ends)))))
    misspelt = joined(homeless, placed.withColumn("part", F.explode(ends(F.col("site")))), ["offering", "part"])
    # The offering passes have no listing without an offering; of a site of any size all that share a word with it are compared.
    own = F.array_except("name_words", "provider_words")
    named = f.where("site is not null").withColumn("word", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))))
    bare = joined(named.where("offering is null"), named, ["site", "word"])
    near = f.where("site is not null").select("id", "source", "site", F.array_join(F.array_sort(own), " ").alias("name_key"))
    near = rank_in_groups(near, "site", [F.col("name_key"), F.col("id")], "place").drop("name_key")
    next_ = near.withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + NEIGHBOURS)))
    third = joined(next_, near, ["site", "place"])
    return first.union(second).union(misspelt).union(bare).union(third).distinct()


FIELDS = ["provider", "spelling", "code", "offering", "name", "text"]


def compared(pairs: DataFrame, f: DataFrame) -> DataFrame:
    """a, b and one agreement level per field; -1 where a field is missing on either side."""
    # All words are needed of listings without a site only.
    f = f.withColumn("words", F.when(F.col("site").isNull(), F.col("words")).otherwise(F.array().cast("array<string>")))
    side = lambda p: f.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("site", "offering", "provider_words", "words", "name_words", "name_telling", "name_meaning", "text_words", "provider", "own_words")])
    both = merged(merged(pairs, side("a"), "a"), side("b"), "b")

    def overlap(x: Column, y: Column) -> Column:
        share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), -1).when(share >= 0.5, 2).when(share >= 0.2, 1).otherwise(0)

    def abbreviates(code: Column, label: Column) -> Column:
        """How well one short word stands for a label: 2 its letters stand in this order in the label and it begins alike, 1 in this order only, 0 not; -1 where it is no such word."""
        code = F.lower(F.trim(code))
        in_order = F.levenshtein(label, code) == F.length(label) - F.length(code)
        alike = F.substring(label, 1, LETTERS) == F.substring(code, 1, LETTERS)
        usable = code.rlike(r"^\p{L}{3,}$") & (F.length(code) < F.length(label))
        return F.when(F.coalesce(usable, F.lit(False)), F.when(in_order & alike, 2).when(in_order, 1).otherwise(0)).otherwise(-1)

    def spelled(own: Column, label: Column) -> Column:
        """How much like the label the nearest word, or two words in a row, of a name are: 2 nearly the same, 1 alike, 0 not; -1 where it has none."""
        two = F.transform(F.when(F.size(own) > 1, F.sequence(F.lit(1), F.size(own) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.element_at(own, i), F.element_at(own, i + 1)))
        like = F.array_max(F.transform(F.concat(own, two), lambda w: 1 - F.levenshtein(w, label) / F.greatest(F.length(w), F.length(label))))
        return F.when(like >= 0.8, 2).when(like >= 0.6, 1).when(like.isNotNull(), 0).otherwise(-1)

    def named(label: Column, words: Column, provider_words: Column, other_words: Column) -> Column:
        """How well the words of a listing without site name the provider ``label``: 2 whole, 1 in part, 0 not at all."""
        shared = F.array_intersect(provider_words, other_words)
        start = F.try_element_at(F.filter(shared, lambda w: F.startswith(label, w)), F.lit(1))
        end = F.try_element_at(F.filter(shared, lambda w: F.endswith(label, w)), F.lit(1))
        rest = F.when(start.isNotNull(), F.substring(label, F.length(start) + 1, 99)).when(end.isNotNull(), F.substring(label, F.lit(1), F.length(label) - F.length(end)))
        misspelt = F.exists(words, lambda w: (F.length(w) >= 4) & (F.levenshtein(w, rest) <= 2))
        whole = (start.isNotNull() & end.isNotNull() & (F.length(start) + F.length(end) == F.length(label))) | misspelt
        return F.when(whole, 2).when(F.size(shared) > 0, 1).otherwise(0)

    offering = F.when(F.col("a_offering").isNull() | F.col("b_offering").isNull(), -1).when(F.col("a_offering") == F.col("b_offering"), 1).otherwise(0)
    loose = F.size(F.array_intersect("a_provider_words", "b_provider_words"))
    provider = (
        F.when(F.col("a_site") == F.col("b_site"), 3)
        .when(F.col("a_site") != F.col("b_site"), 0)
        .when(F.col("a_site").isNotNull(), named(F.col("a_site"), F.col("b_name_words"), F.col("a_provider_words"), F.col("b_words")))
        .when(F.col("b_site").isNotNull(), named(F.col("b_site"), F.col("a_name_words"), F.col("b_provider_words"), F.col("a_words")))
        .otherwise(F.least(F.lit(2), loose))
    )
    # Where one of two listings has no site, its name and the code it gives for its provider are compared with the site of the other.
    only_a, only_b = F.col("a_site").isNotNull() & F.col("b_site").isNull(), F.col("b_site").isNotNull() & F.col("a_site").isNull()
    code = F.when(only_b, abbreviates(F.col("a_provider"), F.col("b_site"))).when(only_a, abbreviates(F.col("b_provider"), F.col("a_site"))).otherwise(-1)
    spelling = F.when(only_b, spelled(F.col("a_own_words"), F.col("b_site"))).when(only_a, spelled(F.col("b_own_words"), F.col("a_site"))).otherwise(-1)
    same_words = F.size(F.array_intersect("a_name_telling", "b_name_telling")) / F.size(F.array_union("a_name_telling", "b_name_telling"))
    name = F.when((F.size("a_name_telling") == 0) | (F.size("b_name_telling") == 0), -1).when(same_words >= 0.5, 2).when(F.arrays_overlap("a_name_meaning", "b_name_meaning"), 1).otherwise(0)
    text = overlap(F.array_except("a_text_words", "a_provider_words"), F.array_except("b_text_words", "b_provider_words"))
    return both.select("a", "b", offering.alias("offering"), provider.alias("provider"), spelling.alias("spelling"), code.alias("code"), name.alias("name"), text.alias("text"))


#: The ways in which two listings can be different things: other providers, or other offerings of one provider.
NON_MATCHES = (("provider", "spelling", "code"), ("offering", "name"))


def expectation_maximisation(patterns: pd.DataFrame, chance: pd.DataFrame, fields: list[str], differ: tuple[tuple[str, ...], ...] = NON_MATCHES, rounds: int = 500, tolerance: float = 1e-7) -> pd.DataFrame:
    """``patterns`` (a level per field, n pairs) with ``confidence``, the posterior probability that pairs of the pattern match.

    A mixture of one class of matches and one class of non-matches for each entry of ``differ``: within a class the levels are
    independent, -1 tells nothing. In the fields in which a non-match class differs it agrees by chance only, as often as the pairs
    in ``chance`` (same columns, drawn at random) do; all other distributions and the shares of the classes are estimated. Every
    count is smoothed, so that a small table rules out no level.
    """
    if patterns.empty:
        return patterns.assign(confidence=pd.Series(dtype=float))
    n = patterns["n"].to_numpy(float)
    level = {f: patterns[f].to_numpy() for f in fields}
    size = {f: int(max(1, level[f].max(), chance[f].max() if len(chance) else 0)) + 1 for f in fields}

    def smoothed(levels: np.ndarray, weights: np.ndarray, f: str, more: float) -> np.ndarray:
        count = np.bincount(levels[levels >= 0], weights[levels >= 0], minlength=size[f]) + more
        return count / count.sum()

    by_chance = {f: smoothed(chance[f].to_numpy(int), chance["n"].to_numpy(float), f, 0.5) for f in fields}
    agree = {f: np.array([0.05] + [0.95 / (size[f] - 1)] * (size[f] - 1)) for f in fields}
    classes = ((), *differ)
    prob = [{f: by_chance[f] if f in apart else agree[f] for f in fields} for apart in classes]
    share = np.full(len(prob), 1 / len(prob))
    post = np.zeros((len(prob), len(n)))
    for _ in range(rounds):
        log = np.log(share)[:, None] + np.zeros_like(post)
        for c, p in enumerate(prob):
            for f in fields:
                seen = level[f] >= 0
                log[c, seen] += np.log(p[f][level[f][seen]])
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        moved, post = np.abs(new - post).max(), new
        share = np.clip((n * post).sum(axis=1) / n.sum(), 1e-6, None)
        share /= share.sum()
        prob = [{f: p[f] if f in apart else smoothed(level[f], n * post[c], f, 0.1) for f in fields} for c, (apart, p) in enumerate(zip(classes, prob))]
        if moved < tolerance:
            break
    return patterns.assign(confidence=post[0])


def random_pairs(f: DataFrame) -> DataFrame:
    """(a, b): each listing with the next one, if of another source, in the order of a hash of the id, spread over tasks by that hash."""
    order = F.xxhash64(F.lit("random"), F.col("id"))
    over = Window.partitionBy(F.pmod(order, F.lit(SALTS))).orderBy(order)
    rows = f.withColumn("n", F.lead(F.struct("id", "source")).over(over)).where("n is not null and n.source <> source")
    return rows.select(F.least("id", "n.id").alias("a"), F.greatest("id", "n.id").alias("b")).distinct()


def linked_listings(apis: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence, and the agreement levels) for every candidate pair of listings of different sources.

    Repeats of an id are one listing. A listing with nothing but an id, or whose only text is residue, has no candidates. Patterns of
    levels, a few hundred at most, are what the driver sees. An empty table gives no rows.
    """
    f = written(with_provider_words(with_offerings(written(listing_features(apis), "listings"))), "features")
    pairs = written(compared(candidate_pairs(f), f), "pairs")
    patterns = pairs.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(FIELDS)
    chance = compared(random_pairs(f), f).groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).toPandas()
    told = expectation_maximisation(patterns, chance, FIELDS)[[*FIELDS, "confidence"]]
    schema = ", ".join(f"{c} int" for c in FIELDS) + ", confidence double"
    confidence = apis.sparkSession.createDataFrame(told, schema) if len(told) else apis.sparkSession.createDataFrame([], schema)
    return pairs.join(F.broadcast(confidence), FIELDS).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "confidence", *FIELDS)
