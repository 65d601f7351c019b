"""Problem 9: how demanding the prose of a document is.

The coverage rank of a text is the size of the smallest frequency-ranked vocabulary that covers a fixed share of its words. Vocabularies
are counted over the whole corpus, one per labelled language; a text is measured in the language that makes its words most likely. Coverage
ranks and sentence lengths are calibrated in SQL on passages of known level.

Every task gets the head of each vocabulary, which settles nearly all texts; the ranks of rarer words are joined to the few texts
whose measure lies beyond the head.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_in_groups
from ..runtime import bounded_broadcast, merged, written
from .hashing import slices

#: Share of the words of a text that the vocabulary must cover.
COVERED = 0.7
#: Words of each vocabulary that are sent to the workers, and words of all languages together; the ranks of the others are joined.
HEAD_WORDS, HEAD_ENTRIES = 20_000, 1_000_000
#: Cells of documents by languages that a worker fills at once.
CHOICE_CELLS = 4_000_000
#: Spreads beyond which a rank is no farther from a level.
FARTHEST = 5.0

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<(script|style|pre|code)\b.*?</\1>", re.S | re.I)
#: Lines that are no prose: headings, table rows, rules, data, link definitions, bare addresses.
_NO_PROSE = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\|.*|.*\|[ \t]*|[-=*_~:| \t]{3,}|[{\[<].*[}\]>],?|\[[^\]]+\]:.*|(?:\w+:)?(?:https?://)?\S+)[ \t]*$", re.M)
_MARK = re.compile(r"^[ \t]*(?:>[ \t]?)*(?:[-*+•–][ \t]+|\d{1,3}[.)][ \t]+)?", re.M)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()]*\)")
_NOISE = re.compile(r"(?:https?://|www\.)\S+|<[^<>\n]{1,200}>|&[a-z]+;|\b[\w.]+@[\w.]+\b|[*_~]{1,3}")
_BREAK = re.compile(r"[.!?…:]+[\"'»”’)\]]*(?=\s|$)|\n[ \t]*\n|\n(?=[A-ZÀ-ÖØ-Þ0-9\x00])")
_WORD = re.compile(r"[^\W\d_]+")
#: Parts with fewer words are labels, not sentences.
MIN_SENTENCE = 3


def _prose(text: str) -> str:
    """Sentences of ``text``, one a line, words separated by one space, lower-cased."""
    if "`" in text or "<" in text or "~~~" in text:
        text = _CODE.sub("\n\n", text)
    text = _MARK.sub(lambda m: "\x00" if m.group().strip(" \t>") else "", _NO_PROSE.sub("\n", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    lines = []
    for part in _BREAK.split(_NOISE.sub(" ", text)):
        words = _WORD.findall(part)
        if len(words) >= MIN_SENTENCE:
            lines.append(" ".join(words).lower())
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [_prose(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text)], names=["key", "lang", "prose"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language, summed within each batch before they leave the task."""
    from collections import Counter

    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, prose in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(prose.split())
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])


def ranked_vocabulary(prose: DataFrame) -> DataFrame:
    """(lang, word, n, rank) from rows (lang, prose) of the whole corpus: per language all words by frequency, ties by word; null languages are left out.

    A language of any size is ranked over many tasks.
    """
    counts = prose.where("lang is not null").select("lang", "prose").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return rank_in_groups(counts, "lang", [F.desc("n"), F.col("word")])


class _Heads:
    """The heads of all vocabularies: word -> index, and per index the languages, ranks and counts of the word, one after the other."""

    def __init__(self, rows, totals: dict[str, int], head: int):
        self.langs = sorted(totals) or ["und"]
        number = {c: i for i, c in enumerate(self.langs)}
        rows = rows.sort_values("word", kind="stable")
        words = rows["word"].drop_duplicates().tolist()
        self.index = {w: i for i, w in enumerate(words)}
        self.start = np.concatenate([np.searchsorted(rows["word"].map(self.index).to_numpy(np.int64), np.arange(len(words))), [len(rows)], [len(rows)]]).astype(np.int64)
        self.lang = rows["lang"].map(number).to_numpy(np.int64)
        self.rank, self.n = rows["rank"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        size = np.array([totals.get(c, 1) for c in self.langs], float)
        # How much likelier a word is in a language than one word among all of the corpus.
        self.gain = np.log(self.n / size[self.lang]) + np.log(max(1.0, size.sum()))
        self.none, self.last = len(words), head + 1


def _positions(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _measurer(shared, covered: float, with_rare: bool):
    def smallest(owner: np.ndarray, rank: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per owner the least rank that covers the share; owners are numbered from 0 and have n > 0 words each."""
        order = np.sort(owner.astype(np.int64) << 32 | rank.astype(np.int64)) & 0xFFFFFFFF
        return order[np.cumsum(n) - n + np.ceil(covered * n).astype(np.int64) - 1]

    def middles(owner: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = value[np.lexsort((value, owner))]
        start = np.cumsum(n) - n
        return v[start + (n - 1) // 2], v[start + n // 2]

    def choice(h: _Heads, token: np.ndarray, at: np.ndarray, flat: np.ndarray, doc: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The language of each document: the greatest sum of gains. A word that only the document itself has brought into the vocabulary of its label does not count there."""
        gain, d = h.gain[at], doc[token]
        own = np.flatnonzero((h.lang[at] == label[d]) & (h.n[at] <= n[d]))
        if len(own):
            _, back, times = np.unique(d[own] * (h.none + 1) + flat[token[own]], return_inverse=True, return_counts=True)
            gain[own[h.n[at[own]] <= times[back]]] = 0.0
        best, step = np.zeros(len(n), np.int64), max(1, CHOICE_CELLS // len(h.langs))
        for first in range(0, len(n), step):
            some = slice(*np.searchsorted(d, [first, first + step]))
            cells = np.bincount((d[some] - first) * len(h.langs) + h.lang[at[some]], gain[some], minlength=min(step, len(n) - first) * len(h.langs))
            best[first : first + step] = cells.reshape(-1, len(h.langs)).argmax(axis=1)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: _Heads = shared.value
        number = {c: i for i, c in enumerate(h.langs)}
        get = h.index.get
        for batch in slices(batches):
            keys, lines = batch.column(0), [p.split("\n") for p in batch.column(2).to_pylist()]
            label = np.array([number.get(c, -1) for c in batch.column(1).to_pylist()], np.int64)
            parts = [[w.split(" ") for w in ls] for ls in lines]
            n_sent = np.array([len(p) for p in parts])
            n_words = np.array([len(s) for p in parts for s in p])
            flat = np.fromiter((get(w, h.none) for p in parts for s in p for w in s), np.int64, int(n_words.sum()))
            sent_doc = np.repeat(np.arange(len(parts)), n_sent)
            sent = np.repeat(np.arange(len(n_words)), n_words)
            doc = sent_doc[sent]
            per_doc = np.bincount(doc, minlength=len(parts))
            # One entry for each language of each word.
            each = h.start[flat + 1] - h.start[flat]
            token = np.repeat(np.arange(len(flat)), each)
            at = np.repeat(h.start[flat], each) + _positions(each)
            best = choice(h, token, at, flat, doc, label, per_doc)
            rank = np.full(len(flat), h.last, np.int64)
            own = h.lang[at] == best[doc[token]]
            rank[token[own]] = h.rank[at[own]]
            whole, each_sent = smallest(doc, rank, per_doc), smallest(sent, rank, n_words)
            low, high = middles(sent_doc, each_sent, n_sent)
            length = sum(middles(sent_doc, n_words, n_sent)) / 2
            # Words beyond the head, of documents whose measure lies there: with how many of them, in order of rank, a sentence is covered.
            beyond = with_rare & ((whole == h.last) | (high == h.last))
            rare: list = [None] * len(parts)
            if beyond.any():
                common = np.bincount(sent, rank < h.last, minlength=len(n_words)).astype(np.int64)
                wanted = np.ceil(covered * n_words).astype(np.int64) - common
                first = np.cumsum(n_sent) - n_sent
                start = np.cumsum(per_doc) - per_doc
                for d in np.flatnonzero(beyond):
                    words = [w for s in parts[d] for w in s]
                    own = np.flatnonzero(rank[start[d] : start[d] + per_doc[d]] == h.last)
                    s = sent[start[d] + own]
                    rare[d] = [{"s": int(a - first[d]), "k": int(wanted[a]), "word": words[i]} for a, i in zip(s, own)]
            common_doc = np.bincount(doc, rank < h.last, minlength=len(parts)).astype(np.int64)
            known = np.bincount(sent_doc, each_sent < h.last, minlength=len(parts)).astype(np.int64)
            out = [keys, pa.array([h.langs[b] for b in best]), pa.array(whole, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(length), pa.array(n_sent, pa.int64()), pa.array(per_doc, pa.int64()),
                   pa.array(np.ceil(covered * per_doc).astype(np.int64) - common_doc), pa.array((n_sent - 1) // 2 - known), pa.array(n_sent // 2 - known), pa.array(rare, _RARE)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "lang", "coverage_rank", "low", "high", "sentence_words", "sentences", "words", "k", "i", "j", "rare"])

    return run


_RARE = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int64()), ("word", pa.string())]))
_FEATURES = "key string, lang string, coverage_rank long, low long, high long, sentence_words double, sentences long, words long, k long, i long, j long, rare array<struct<s:int,k:long,word:string>>"

#: Per language and level the mean of each logarithmic measure, and their spread around these means. Languages without samples take the row of lang null.
_CALIBRATION = """
WITH f AS (SELECT s.reading_level, m.lang, ln(m.coverage_rank) AS a, ln(m.sentence_rank) AS b, ln(m.sentence_words) AS c FROM {samples} s JOIN {measured} m ON s.key = m.key),
g AS (SELECT lang, reading_level, a, b, c FROM f UNION ALL SELECT CAST(NULL AS STRING), reading_level, a, b, c FROM f),
means AS (SELECT lang, reading_level, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM g GROUP BY lang, reading_level),
spread AS (SELECT g.lang, sqrt(avg(pow(g.a - m.a, 2)) + 0.01) AS sa, sqrt(avg(pow(g.b - m.b, 2)) + 0.01) AS sb, sqrt(avg(pow(g.c - m.c, 2)) + 0.01) AS sc
           FROM g JOIN means m ON g.lang <=> m.lang AND g.reading_level = m.reading_level GROUP BY g.lang)
SELECT m.lang, m.reading_level, m.a, m.b, m.c, s.sa, s.sb, s.sc FROM means m JOIN spread s ON m.lang <=> s.lang
"""


class Vocabulary:
    """The ranked words of every labelled language, the head of which is sent to the workers once."""

    def __init__(self, ranked: DataFrame):
        self.ranked = ranked
        spark = ranked.sparkSession
        # One row per labelled language.
        sizes = ranked.groupBy("lang").agg(F.sum("n").alias("n"), F.max("rank").alias("last")).toPandas()
        self.head = min(HEAD_WORDS, max(1, HEAD_ENTRIES // max(1, len(sizes))))
        self.longest = int(sizes["last"].max()) if len(sizes) else 0
        rows = ranked.where(F.col("rank") <= self.head).select("lang", "word", "rank", "n").toPandas()
        self.shared = spark.sparkContext.broadcast(_Heads(rows, dict(zip(sizes["lang"], sizes["n"])), self.head))


def measured(prose: DataFrame, vocabulary: Vocabulary, covered: float = COVERED) -> DataFrame:
    """key, lang, coverage_rank, sentence_rank (median coverage rank of its sentences), sentence_words (median), sentences, words for rows (key, lang, prose) with prose.

    A word that the measured language does not have ranks after the last word of the longest vocabulary, and after the head.
    """
    columns = ["key", "lang", "coverage_rank", ((F.col("low") + F.col("high")) / 2).alias("sentence_rank"), "sentence_words", "sentences", "words"]
    first = prose.where("prose <> ''").select("key", "lang", "prose").mapInArrow(_measurer(vocabulary.shared, covered, vocabulary.longest > vocabulary.head), _FEATURES)
    if vocabulary.longest <= vocabulary.head:
        return first.select(*columns)
    first = written(first.withColumn("x", F.xxhash64("rare")), "measures")
    rare = first.where("rare is not null").dropDuplicates(["key", "x"]).select("key", "x", "lang", F.explode("rare").alias("r")).select("key", "x", "lang", "r.s", "r.k", "r.word")
    ranked = merged(rare, vocabulary.ranked.select("lang", "word", "rank"), ["lang", "word"], "left").withColumn("rank", F.coalesce("rank", F.lit(vocabulary.longest + 1)))
    # Words of one sentence, then of one document.
    sentences = ranked.groupBy("key", "x", "s", "k").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    docs = sentences.groupBy("key", "x").agg(F.sort_array(F.flatten(F.collect_list("ranks"))).alias("all"), F.sort_array(F.collect_list(F.when(F.col("k") > 0, F.get("ranks", (F.col("k") - 1).cast("int"))))).alias("beyond"))
    exact = lambda known, at, ranks: F.when(F.col("all").isNotNull() & (at >= 0), F.get(ranks, at.cast("int"))).otherwise(F.col(known))
    both = merged(first, docs, ["key", "x"], "left")
    both = both.withColumn("coverage_rank", exact("coverage_rank", F.col("k") - 1, "all")).withColumn("low", exact("low", F.col("i"), "beyond")).withColumn("high", exact("high", F.col("j"), "beyond"))
    return both.select(*columns)


def reading_levels(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_level: str = "reading_level", sample_text: str = "text") -> DataFrame:
    """One row per document with prose: its id, lang (as measured), coverage_rank, sentence_rank, sentence_words, sentences, words, level.

    level is the level of the samples whose mean coverage rank, median sentence rank and median sentence length, in logarithms and in
    units of their spread (the ranks FARTHEST at most), are nearest (ties: the lower level); medians keep single sentences from deciding, and the rank over all
    words and the rank of the median sentence must both speak for a level. Labels of ``lang`` only choose in which vocabulary a
    document is counted; wrong ones shift ranks a little, and the measured language does not depend on them. Every labelled language
    has a vocabulary of all its words. Documents in a language without samples take the calibration of all samples together.
    Documents without prose (null, empty, only code or tables) have no row. Without samples nothing has a level and the result is
    empty. Whole texts are read; vocabularies are counted over all documents.
    """
    spark = docs.sparkSession
    label = F.lower(F.trim(F.col(lang)))
    label = F.when(label.isin("und", "unknown", "zxx", "mul", ""), None).otherwise(label)
    own = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("key"), label.alias("lang"), F.col(text).alias("text"))
    prose = written(own.mapInArrow(_extract, "key string, lang string, prose string"), "prose")
    vocabulary = Vocabulary(written(ranked_vocabulary(prose), "vocabulary"))
    known = samples.where(F.col(sample_level).isNotNull() & F.col(sample_text).isNotNull()).select(F.xxhash64(sample_text, sample_level).cast("string").alias("key"), F.lit(None).cast("string").alias("lang"), F.col(sample_text).alias("text"), F.col(sample_level).alias("reading_level")).dropDuplicates(["key"])
    sample_prose = known.select("key", "lang", "text").mapInArrow(_extract, "key string, lang string, prose string")
    calibration = spark.sql(_CALIBRATION, samples=known.select("key", "reading_level"), measured=measured(sample_prose, vocabulary))
    calibration = written(calibration, "calibration")
    with_samples = [r[0] for r in calibration.where("lang is not null").select("lang").distinct().collect()]
    table = calibration.groupBy("lang").agg(F.collect_list(F.struct("reading_level", "a", "b", "c", "sa", "sb", "sc")).alias("levels"))
    rows = measured(prose, vocabulary).withColumn("_at", F.when(F.col("lang").isin(with_samples), F.col("lang")).otherwise(F.lit("")))
    table = bounded_broadcast(table.select(F.coalesce("lang", F.lit("")).alias("_at"), "levels"))
    # Neither rank counts for more than FARTHEST spreads, so that neither decides alone.
    apart = lambda c, mean, spread: F.pow((F.ln(c) - mean) / spread, F.lit(2))
    most = F.lit(FARTHEST**2)
    far = lambda x: F.least(apart("coverage_rank", x.a, x.sa), most) + F.least(apart("sentence_rank", x.b, x.sb), most) + apart("sentence_words", x.c, x.sc)
    nearest = F.array_min(F.transform("levels", lambda x: F.struct(far(x).alias("far"), x.reading_level.alias("level"))))
    return rows.join(table, "_at").select(F.col("key").cast(docs.schema[doc_id].dataType).alias(doc_id), "lang", "coverage_rank", "sentence_rank", "sentence_words", "sentences", "words", nearest["level"].alias("level"))
