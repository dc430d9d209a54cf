"""Language identification of mixed texts.

A word is a run of letters (Unicode's categories L), with the combining marks after them.  Its letters' scripts, by
ranges of code points, leave the languages that write in all of them.  Of these, each gets the word's probability under
its character trigrams, of which only those seen are stored.  Viterbi over a text's words, with a penalty for a change
of language, labels spans; a text's language is the one that holds most of its letters.

The trigrams are counted on at most SAMPLE training rows of each language, whole buckets of least hashes, repeated rows
once; so every language of the training rows is learned, however rare, with all letters that its rows have.  Held-out rows' lang,
and source and doc_id, are never read for a prediction.

Defined results.  A null text, or one without a letter, is ``und`` with score 0, and so is any text if there are
no training rows.  Words whose scripts no language has all of may be any language.  Ties go to the first language by
code point.  A text of any length is labelled whole.  A null doc_id is not held out.  Repeated rows get equal
predictions.  An empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import Tables, join_unique
from quire.llm.toxicity import held_out

#: Training rows of a language, and buckets of the histogram that finds them.
SAMPLE, BUCKETS = 5_000, 4096
SWITCH = 9.0
#: A word's score counts at most this much, in nats, against any language: one name is not a language.
MOST = 12.0
#: A language writes in a script if so much of its training letters is in it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Smoothing: the weight of a pair's probability in a trigram's, and what is added to a pair's count.
BACKOFF, ADDED = 2.0, 0.1
#: First code points of scripts; a range goes up to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
KIND = np.array([NAMES.index(n) for _, n in SCRIPTS])


def _class(categories: str) -> str:
    """A regular expression's set of the code points whose category begins with one of these letters."""
    has = np.array([unicodedata.category(chr(c))[0] in categories for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(has.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


WORD = re.compile(f"[{_class('L')}][{_class('LM')}]*")


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)


def scripts(p: np.ndarray) -> np.ndarray:
    return KIND[np.searchsorted(STARTS, p, "right") - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter and script counts, by language."""
    total: dict[tuple[str, int], int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, n = np.unique(points("".join(WORD.findall((text or "").lower()))), return_counts=True)
            for c, k in zip(found.tolist(), n.tolist(), strict=True):
                total[lang, c] = total.get((lang, c), 0) + k
    yield pa.record_batch([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "c", "n"])


class Alphabet:
    """Code points to symbols: 0 a word's edge, 1 any letter not seen in training, then the letters seen."""

    def __init__(self, letters: list[int]):
        self.letters = np.array(sorted(letters), dtype=np.int64)
        self.size = len(letters) + 2

    def symbols(self, p: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.letters, p), len(self.letters) - 1)
        return np.where(p == 32, 0, np.where(self.letters[i] == p, i + 2, 1))

    def trigrams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigram numbers of the words, one after the other, and where each word's begin."""
        p = points("  " + "  ".join(words) + " ")
        s = self.symbols(p)
        grams = (s[:-2] * self.size + s[1:-1]) * self.size + s[2:]
        # a word of n letters has n + 1: edge edge first ... last edge
        n = np.array([len(w) + 2 for w in words])
        return grams, np.cumsum(n) - n


def _count_trigrams(alphabet, langs: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Alphabet = alphabet.value
        number = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := WORD.findall((text or "").lower()):
                    found.append(a.trigrams(words)[0] * len(langs) + number[lang])
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    return count


class Counts:
    """Sums by key: of the keys given, those that have any."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.n = key[first], np.add.reduceat(n, first).astype(np.float64) if len(first) else np.zeros(0)

    def of(self, key: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, self.n[i], 0.0)


class Model:
    """Trigram counts of the languages; a key is a trigram's, pair's or letter's number times the languages, plus the language's."""

    def __init__(self, langs: list[str], alphabet: Alphabet | None = None, key: np.ndarray | None = None, n: np.ndarray | None = None, writes: np.ndarray | None = None):
        #: writes: a row a script, if a language has it
        self.langs, self.alphabet, self.writes = langs, alphabet, writes
        if langs:
            lang, gram, size = key % len(langs), key // len(langs), alphabet.size
            self.three = Counts(key, n)
            self.before = Counts(gram // size * len(langs) + lang, n)  # trigrams by their first two
            self.two = Counts(gram % size**2 * len(langs) + lang, n)  # and by their last two
            self.one = Counts(gram // size % size * len(langs) + lang, n)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """-log probability of each trigram's last letter, a column a language."""
        langs, size = np.arange(len(self.langs)), self.alphabet.size
        at = lambda x: x[:, None] * len(self.langs) + langs
        pair = (self.two.of(at(grams % size**2)) + ADDED) / (self.one.of(at(grams // size % size)) + ADDED * size)
        return -np.log((self.three.of(at(grams)) + BACKOFF * pair) / (self.before.of(at(grams // size)) + BACKOFF))

    def word_costs(self, words: list[str]) -> np.ndarray:
        """A row a word, a cost a language, the best at 0; languages that don't write its scripts cost MOST."""
        grams, at = self.alphabet.trigrams(words)
        seen, of = np.unique(grams, return_inverse=True)
        cost = np.add.reduceat(self.costs(seen)[of], at, axis=0)
        letters = points("".join(words))
        begin = np.cumsum([0] + [len(w) for w in words[:-1]])
        may = np.logical_and.reduceat(self.writes[scripts(letters)], begin, axis=0)
        may[~may.any(axis=1)] = True
        cost = np.where(may, cost, np.inf)
        cost -= cost.min(axis=1, keepdims=True)
        return np.minimum(cost, MOST).astype(np.float32)


def sample(rows: DataFrame, tables: Tables) -> DataFrame:
    """(text, lang) of at most SAMPLE rows a language, those of least hash; ``rows``: text, lang, h."""
    ids = tables.cut(rows.select("lang", "h").distinct(), "lang-ids")
    sizes = tables.cut(ids.groupBy("lang").agg(F.count("*").alias("rows")), "lang-sizes")
    near = join_unique(ids, sizes.withColumn("n", F.col("rows")), ["lang"], "inner")
    # the least quarter of what is looked at, by a histogram of the hashes: no language's rows are sorted
    place = F.shiftrightunsigned("h", 1) / F.lit(2.0**63) * F.col("n") / (4 * SAMPLE)
    near = near.withColumn("place", F.floor(place * BUCKETS)).filter(place <= 1)
    sums = near.groupBy("lang", "place").agg(F.count("*").alias("c"))
    sums = sums.withColumn("upto", F.sum("c").over(Window.partitionBy("lang").orderBy("place")))
    chosen = near.join(sums.filter(F.col("upto") <= SAMPLE).select("lang", "place"), ["lang", "place"])
    chosen = tables.cut(chosen.select("lang", "h"), "lang-sample")
    out = tables.cut(rows.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang"), "lang-rows")
    for t in (ids, sizes, chosen):
        tables.drop(t)
    return out


def fit(spark: SparkSession, docs: DataFrame, tables: Tables) -> Model:
    """``docs`` (doc_id, text, lang)."""
    rows = docs.filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    chosen = sample(rows.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")), tables)
    letters = chosen.mapInArrow(_count, "lang string, c bigint, n bigint").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    letters = tables.cut(letters, "lang-letters").collect()  # letters of SAMPLE texts a language at most
    langs = sorted({r.lang for r in letters})
    if not langs:
        return Model([])
    alphabet = Alphabet(sorted({r.c for r in letters}))
    writes = np.zeros((len(NAMES), len(langs)))
    for r in letters:
        writes[int(scripts(np.array([r.c]))[0]), langs.index(r.lang)] += r.n
    writes = writes / writes.sum(axis=0, keepdims=True) >= SCRIPT_SHARE
    found = chosen.mapInArrow(_count_trigrams(spark.sparkContext.broadcast(alphabet), langs), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.toArrow()  # trigrams of SAMPLE texts a language at most
    tables.drop(chosen)
    return Model(langs, alphabet, found["key"].to_numpy(), found["n"].to_numpy(), writes)


def viterbi(costs: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The cheapest language of each word of each text; the texts go in step, a word of each at a time."""
    order = sorted(range(len(costs)), key=lambda i: -len(costs[i]))
    n = np.array([len(costs[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(costs)
    if not len(n) or not n[0]:
        return out
    flat = np.concatenate([costs[i] for i in order if len(costs[i])])
    place = np.cumsum(n) - n
    langs = flat.shape[1]
    come = np.zeros((len(flat), langs), dtype=np.min_scalar_type(langs))
    live = int((n > 0).sum())
    total = flat[place[:live]].astype(np.float64)
    ends = np.zeros(len(n), dtype=np.int64)
    for step in range(1, int(n[0]) + 1):
        now = int(np.searchsorted(-n, -step, "left"))  # texts that have a word here
        ends[now:live] = total[now:live].argmin(axis=1)
        live, total = now, total[:now]
        if not live:
            break
        best = total.argmin(axis=1)
        jump = total[np.arange(live), best] + switch
        stay = total <= jump[:, None]
        come[place[:live] + step] = np.where(stay, np.arange(langs), best[:, None])
        total = np.where(stay, total, jump[:, None]) + flat[place[:live] + step]
    path = np.zeros(len(flat), dtype=np.int64)
    some = n > 0
    path[place[some] + n[some] - 1] = ends[some]
    for step in range(int(n[0]) - 1, 0, -1):
        now = int(np.searchsorted(-n, -step, "left"))
        at = place[:now] + step
        path[at - 1] = come[at, path[at]]
    for k, i in enumerate(order):
        out[i] = path[place[k] : place[k] + n[k]]
    return out


class Labeller:
    """Labels texts; keeps the costs of words that it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)), dtype=np.float32)

    def costs(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.known))
        if new:
            if len(self.known) > 1 << 19:
                self.known.clear()
                self.rows = self.rows[:0]
                new = list(dict.fromkeys(w for words in texts for w in words))
            self.known.update((w, len(self.rows) + i) for i, w in enumerate(new))
            self.rows = np.concatenate([self.rows, *[self.model.word_costs(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]])
        return [self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))] for words in texts]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """Each text's words and their languages."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        return list(zip(words, viterbi(self.costs(words), SWITCH), strict=True))


def _groups(texts: list[str | None], most: int = 4 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        labeller = Labeller(m) if m.langs else None
        for batch in batches:
            out = []
            for part in _groups(batch.column(1).to_pylist()):
                for words, path in labeller.label(part) if labeller else [([], None)] * len(part):
                    if not words:
                        out.append((UNKNOWN, 0.0))
                        continue
                    share = np.bincount(path, weights=[len(w) for w in words], minlength=len(m.langs))
                    best = int(share.argmax())
                    out.append((m.langs[best], float(share[best] / share.sum())))
            yield pa.record_batch([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return predict


def _spanner(model):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        labeller = Labeller(m) if m.langs else None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if labeller is None or not text:
                    continue
                [(words, path)] = labeller.label([text])
                if not words:
                    continue
                places = [x.span() for x in WORD.finditer(text.lower())]
                edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
                rows += [(doc_id, places[a][0], places[b - 1][1], m.langs[path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "start", "stop", "lang"])

    return spans


def spans(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, stop, lang): the spans of each text (lower-cased) and their languages."""
    return docs.select("doc_id", "text").mapInArrow(_spanner(spark.sparkContext.broadcast(model)), "doc_id bigint, start int, stop int, lang string")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document."""
    model = fit(spark, docs.select("doc_id", "text", "lang"), Tables(spark))
    rows = docs.select("doc_id", "text").mapInArrow(_predictor(spark.sparkContext.broadcast(model)), "doc_id bigint, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
