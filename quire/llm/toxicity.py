"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Tokens that look disguised (digits or signs among
letters, letters said three times and more, letters spelled one by one) become lattices: each sign may stand for
letters, be a separator, or repeat what stands before it.  Viterbi finds the likeliest word under the trigram
model, and the restored words join the text's own.  Words and word beginnings that labelled toxic rows have more
often than others weigh in; a logistic curve over a text's weights gives the score.

The classifier is fitted on at most SAMPLE labelled rows, those of least hash; the trigram counts, and the scores,
are over all rows.  Labels of held-out rows, and lang, source and doc_id, are never read for a score.

Defined results.  A null or empty text is scored as a text without weights.  Without labelled rows, or without
both labels among them, every score is 0.  A row labelled more than once counts as toxic if any label says so;
null labels are ignored.  A null doc_id is not held out.  Repeated rows get equal scores.  Texts and tokens of any
length are read whole.  Of restorations that cost the same the one whose first letters come first is taken.  Other
columns, whatever their names, are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.shared import Tables

SAMPLE = 20_000
THRESHOLD = 0.3
#: Documents that a feature must be in, and the least log-likelihood ratio (in nats) and weight that it must have.
LEAST_DOCS, LEAST_RATIO, LEAST_WEIGHT = 3, 7.0, 2.0
PREFIXES = (4, 5, 6)
#: Letters that a sign may stand for.
SIGNS = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "aeiou"}
SEPARATORS = ".-_*~'/"
#: Costs, in nats, of a sign for a letter, of dropping a repeated letter, a separator, or any other sign.
SIGN, REPEAT, SEPARATOR, JUNK, LOST_SIGN = 0.7, 0.4, 0.5, 5.0, 12.0
#: Cost of dropping a repeated letter where doubled letters are taken as meant.
DOUBLE = 4.0
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
GAP, OTHER, SYMBOLS = 26, 27, 28
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\S+")
SPELLED = re.compile(r"(?<!\S)(?:[^\s][ ]){3,}[^\s](?!\S)")
DOTTED = re.compile(r"^(?:[^\W_][.\-_*~'/])+[^\W_]$")
THRICE = re.compile(r"([^\W\d_])\1\1|(?:([^\W\d_])\2){3}")
TRIM = ".,;:?\"'()[]{}<>"


def _fold(c: str) -> str:
    return unicodedata.normalize("NFKD", c)[0] if c > "\x7f" else c


def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x10000; above are others."""
    table = np.full(1 << 16, GAP, dtype=np.int64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            f = _fold(c).lower()
            table[i] = ALPHABET.find(f) if f in ALPHABET and len(f) == 1 else OTHER
    return table


@lru_cache(1)
def symbols() -> np.ndarray:
    return _symbols()


def trigram_index(text: str) -> np.ndarray:
    """Trigram numbers of a text, gaps in a row counted as one."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(points < 1 << 16, symbols()[np.minimum(points, 0xFFFF)], OTHER)
    s = np.concatenate([[GAP, GAP], s, [GAP]])
    keep = np.ones(len(s), dtype=bool)
    keep[2:] = (s[2:] != GAP) | (s[1:-1] != GAP)
    s = s[keep]
    s = np.concatenate([[GAP], s]) if len(s) < 3 else s
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        texts, size = [], 0
        for t in [*batch.column(0).to_pylist(), None]:
            if t:
                texts.append(t)
                size += len(t)
            if texts and (size > 1 << 20 or t is None):
                total += np.bincount(trigram_index("\n".join(texts)), minlength=len(total))
                texts, size = [], 0
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["gram", "n"])


def trigram_model(docs: DataFrame) -> np.ndarray:
    """-log P(third | first two), as (28, 28, 28); counted over all texts."""
    rows = docs.select("text").mapInArrow(_count_trigrams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for gram, n in rows.collect():  # 28 ** 3 rows at most
        counts[gram] = n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0) + 0.5
    backoff = pairs / pairs.sum(axis=1, keepdims=True)
    smooth = counts + 4 * backoff[None]
    return -np.log(smooth / smooth.sum(axis=2, keepdims=True))


class Restorer:
    """Viterbi over a token's lattice."""

    def __init__(self, model: np.ndarray):
        self.cost = model.tolist()
        self.known: dict[tuple[str, float], str] = {}

    @staticmethod
    def options(c: str, before: str, repeat: float) -> list[tuple[int, float]]:
        """(symbol or -1 for nothing, cost) of a character."""
        f = _fold(c).lower()
        out = []
        if len(f) == 1 and f in ALPHABET:
            out.append((ALPHABET.index(f), 0.0))
            if f == _fold(before).lower()[:1]:
                out.append((-1, repeat))
            return out
        if c in SIGNS:
            out += [(ALPHABET.index(x), SIGN + math.log(len(SIGNS[c]))) for x in SIGNS[c]]
            if c == before:
                out.append((-1, repeat))
        if c in SEPARATORS or c == " ":
            out.append((-1, SEPARATOR))
        elif c.isalpha():
            out.append((OTHER, 0.0))
        else:
            out.append((-1, LOST_SIGN if c in SIGNS else JUNK))
        return out

    def best(self, token: str, repeat: float = REPEAT) -> str:
        """The likeliest letters behind a token."""
        if (hit := self.known.get((token, repeat))) is not None:
            return hit
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(GAP, GAP): (0.0, None)}
        before = ""
        for c in token:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for s, extra in self.options(c, before, repeat):
                    key, total = ((a, b), cost + extra) if s < 0 else ((b, s), cost + extra + self.cost[a][b][s])
                    if key not in after or total < after[key][0]:
                        after[key] = (total, path if s < 0 else (s, path))
            states, before = after, c
        _, path = min(((cost + self.cost[a][b][GAP], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(ALPHABET[path[0]] if path[0] < 26 else "?")
            path = path[1]
        out = "".join(reversed(letters))
        if len(self.known) > 1 << 16:
            self.known.clear()
        self.known[token, repeat] = out
        return out

    def restored(self, text: str) -> list[str]:
        """The words found behind disguised tokens."""
        out: list[str] = []
        for m in SPELLED.findall(text):
            word = self.best(m.replace(" ", ""))
            out += [word, word[1:], word[2:]]  # a word of one letter may stand before
        for token in set(text.split()):
            if token.isalpha() and not THRICE.search(token):
                continue
            core = token.strip(TRIM).rstrip("!")
            letters = sum(map(str.isalpha, core))
            if letters < 1 or len(core) < 3:
                continue
            signs = sum(c in SIGNS for c in core)
            if signs and 2 * (letters + signs) > len(core) or THRICE.search(core) or DOTTED.match(core):
                out += {self.best(core), self.best(core, DOUBLE)}
        return [w for w in out if len(w) > 2]


def words_of(text: str, restorer: Restorer) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words.union(restorer.restored(text))


def _features(word: str) -> list[str]:
    return [word, *[word[:n] + "^" for n in PREFIXES if len(word) > n]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sampled_words(model):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            found = [sorted({f for w in words_of(t or "", restorer) for f in _features(w)}) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "features"])

    return emit


def _summary(words: set[str], weights: dict[str, float], known: dict[str, float]) -> tuple[float, float]:
    """The largest weight of a text's words, and the logarithm of their sum."""
    most = total = 0.0
    for w in words:
        x = known.get(w)
        if x is None:
            x = max((weights.get(f, 0.0) for f in _features(w)), default=0.0)
            if len(known) > 1 << 19:
                known.clear()
            known[w] = x
        if x:
            total += x
            most = max(most, x)
    return most, math.log1p(total)


class Model:
    """The trigram model, the features' weights and the logistic curve's three numbers."""

    def __init__(self, trigrams: np.ndarray, weights: dict[str, float], curve: tuple[float, float, float] | None):
        self.trigrams, self.weights, self.curve = trigrams, weights, curve

    def score(self, text: str, restorer: Restorer, known: dict[str, float]) -> float:
        if self.curve is None:
            return 0.0
        most, total = _summary(words_of(text, restorer), self.weights, known)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * total))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, tables: Tables) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    trigrams = trigram_model(docs)
    shared = spark.sparkContext.broadcast(trigrams)
    labels = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = tables.cut(chosen, "labelled")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    rows = rows.mapInArrow(_sampled_words(shared), "toxic int, features array<string>")
    rows = tables.cut(rows.dropDuplicates(), "labelled-words")  # copies tell nothing new
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model(trigrams, {}, None)
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= LEAST_DOCS)
    share = toxic / total
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    ratio = part(t, n * share) + part(n - t, n * (1 - share))
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((n - t + 0.5) / (total - toxic + 1))
    best = counts.select("f", ratio.alias("ratio"), weight.alias("weight")).filter((F.col("ratio") > LEAST_RATIO) & (F.col("weight") > LEAST_WEIGHT))
    weights = {r.f: r.weight for r in best.collect()}  # words of SAMPLE texts at most
    known = spark.sparkContext.broadcast(weights)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for batch in batches:
            out = [_summary({f for f in features if not f.endswith("^")}, known.value, seen) for features in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], names=["toxic", "most", "total"])

    points = np.array(rows.mapInArrow(summaries, "toxic int, most double, total double").collect())  # SAMPLE rows at most
    tables.drop(rows)
    return Model(trigrams, weights, _fit_curve(points[:, 1:], points[:, 0]))


def _scorer(model, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        restorer, known = Restorer(m.trigrams), {}
        for batch in batches:
            scores = [m.score(t or "", restorer, known) for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    return score


def scored(spark: SparkSession, docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the score in a column ``name``, which it must not have yet."""
    fields = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model), name), fields)


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    docs = docs.select("doc_id", "text")
    model = fit(spark, docs, labels, Tables(spark))
    rows = _scores_only(spark, docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores_only(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, known = Restorer(m.trigrams), {}
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([m.score(t or "", restorer, known) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id bigint, score double")
