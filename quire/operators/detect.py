"""Detectors and guardrails over one text: predicates and the reasons for them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quire.functions import rules as R
from quire.functions import text as T

#: Characters of a passage that is long, and the odd base of its hash.
LONG, BASE = 120, np.uint64(0x9E3779B97F4A7C15)
SENTENCE = r"\n+|(?<=[.!?])\s+"


def max_count(items: Column) -> Column:
    """How often the commonest item of an array is in it: the longest run of the sorted array."""
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    longest = lambda s, b: F.coalesce(F.array_max(F.transform(b, lambda i, k: F.coalesce(F.get(b, k + 1), F.size(s)) - i)), F.lit(0))
    # array_sort with its own order compares by a function; sort_array does not
    return T.let(F.sort_array(items), lambda s: T.let(begins(s), lambda b: longest(s, b)))


def repetition_anomaly(c: Column) -> Column:
    """A line three times, or one longer word that holds a large share of a long text."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]*)"), 1)
    relevant = F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin(R.IGNORED_WORDS))
    heavy = lambda ws: T.let(F.when(F.size(ws) >= 40, max_count(ws)), lambda top: (top >= 12) & (top / F.size(ws) >= 0.12))
    return (F.coalesce(max_count(T.nonblank_lines(c)), F.lit(0)) >= 3) | F.coalesce(T.let(relevant, heavy), F.lit(False))


def language_anomaly(c: Column, mode: str = "refine") -> Column:
    low = F.lower(c)
    words = F.regexp_extract_all(c, F.lit(r"\b([a-zA-Z]{4,})\b"), 1)
    english = T.let(words, lambda ws: F.size(F.filter(ws, lambda w: F.lower(w).isin(list(R.COMMON_ENGLISH)))) / F.greatest(F.size(ws), F.lit(1)))
    portuguese = T.contains_any(F.concat(F.lit(" "), low, F.lit(" ")), R.PORTUGUESE_MARKERS)
    out = (c == "") | c.rlike("[一-鿿]{6,}") | T.contains_any(low, R.FOREIGN_PHRASES) | T.contains_any(low, R.ASSISTANT_MARKERS)
    return out if mode == "translate" else out | ((english > 0.25) & ~portuguese)


def structure_anomaly(c: Column) -> Column:
    low = F.lower(c)
    unpaired = lambda a: F.contains(low, F.lit(f"### texto_{a}_inicio")) & ~F.contains(low, F.lit(f"### texto_{a}_fim"))
    return unpaired("traduzido") | unpaired("refinado") | T.contains_any(low, R.STRUCTURE_MARKERS)


def token_run(c: Column) -> Column:
    """A word of three letters or more, eight times in a row."""
    return c.rlike(r"(?iu)\b(\w{3,})(?:\s+\1){7,}\b")


def symbol_ratio(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length(c), F.lit(1))


def collapse_reasons(c: Column, original_length: Column | None = None, mode: str = "refine") -> Column:
    """Why a model's output looks broken; none where it translates."""
    if mode == "translate":
        return F.array().cast("array<string>")
    long_lines = F.filter(T.nonblank_lines(c), lambda x: F.length(x) >= 20)
    symbols = T.contains_any(c, ("$$$$", "<think>", "<analysis>")) | (symbol_ratio(c) > 0.35) | (F.contains(c, F.lit("###")) & ~T.contains_any(c, ("TEXTO_TRADUZIDO", "TEXTO_REFINADO")))
    reasons = [("repeated_lines", max_count(long_lines) >= 3), ("repeated_token_run", token_run(c)), ("excess_cjk", F.regexp_count(c, F.lit("[一-鿿]")) > 10), ("bad_symbols", symbols)]
    if original_length is not None:
        ratio = F.length(c) / F.greatest(original_length, F.lit(1))
        reasons.append(("bad_ratio", (ratio < 0.5) | (ratio > 3.0)))
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]), lambda x: x.isNotNull())
    return F.when(c == "", F.array(F.lit("empty"))).otherwise(found)


def lexical_diversity(c: Column) -> Column:
    return T.let(T.words_of(c), lambda words: F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))


def repeats_at_once(text: str, least: int = LONG) -> bool:
    """Whether a passage of ``least`` characters or more stands twice, with white space between.

    What follows the white space begins with ``least`` characters that also begin the passage; those are found by
    a rolling hash of all places at once, and then compared.
    """
    if len(text) < 2 * least + 1:
        return False
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.full(len(c) + 1, BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)  # modulo 2 ** 64, as all sums here
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(c * power[:-1])])
    n = len(c) - least + 1
    h = (total[least:] - total[:n]) * power[:n][::-1]  # each scaled to the last place's power
    gaps = [(m.start(), q) for m in re.finditer(r"\s+", text) for q in range(m.start() + 1, m.end() + 1) if q < n]
    if not gaps:
        return False
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    wanted = h[np.array([q for _, q in gaps])]
    lo, hi = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
    for i in np.flatnonzero(hi - lo > 1):
        p, q = gaps[i]
        for j in order[lo[i] : hi[i]].tolist():
            end = max(p, j + least)  # the passage may end in white space
            if end < q and text[j:end] == text[q : q + end - j]:
                return True
    return False


def long_repeat():
    """``repeats_at_once`` as a column function, in Arrow batches."""

    @F.pandas_udf(BooleanType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(t) and repeats_at_once(t))

    return check


def suspicious_repetition(c: Column) -> Column:
    """Two of: a long passage at once again, few distinct words, a sentence three times."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)
    few = (F.size(tokens) >= 40) & (F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)) < 0.25)
    sentences = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+", -1), T.strip), lambda s: s != "")
    return long_repeat()(c).cast("int") + few.cast("int") + (max_count(sentences) >= 3).cast("int") >= 2


def short_line_peak(c: Column) -> Column:
    """How often the commonest line of at most 25 characters is there."""
    return max_count(F.transform(F.filter(T.nonblank_lines(c), lambda x: F.length(x) <= 25), F.lower)).cast("bigint")


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sentence) split at line ends and behind . ! ?"""
    parts = F.posexplode(F.split("text", SENTENCE, -1)).alias("sent_no", "sentence")
    return docs.select("doc_id", parts).withColumn("sentence", T.strip(F.col("sentence")))


def english_leaks(docs: DataFrame) -> DataFrame:
    """The sentence table's rows that read as English in a Portuguese text."""
    words = F.transform(F.regexp_extract_all("sentence", F.lit(r"([A-Za-z]+(?:['’][A-Za-z]+)?)"), 1), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
    rows = sentence_table(docs).filter(F.length("sentence") >= 35).withColumn("w", words).withColumn("n", F.size("w"))
    hits = F.size(F.filter("w", lambda w: w.isin(R.ENGLISH_WORDS))) + 2 * F.regexp_count("sentence", F.lit("(?i)" + R.ENGLISH_CONTRACTIONS)) + F.regexp_count("sentence", F.lit(R.ENGLISH_POSSESSIVE))
    rows = rows.filter("n >= 6").withColumns({"en": hits, "pt": F.size(F.filter("w", lambda w: w.isin(R.PORTUGUESE_WORDS)))})
    leak = ((F.col("n") >= 10) & (F.col("en") >= 5) & (F.col("en") / F.col("n") >= 0.25)) | ((F.col("en") >= 4) & (F.col("en") >= F.col("pt") + 2))
    return rows.filter(leak).select("doc_id", "sent_no", "sentence", F.col("en").cast("bigint").alias("english_hits"))


def english_quick_leak(c: Column) -> Column:
    """The first word or phrase that alone tells of English left over, or null."""
    token = F.regexp_extract(c, r"(?i)\b(" + "|".join(sorted(R.ENGLISH_TOKENS)) + r")\b", 1)
    phrase = F.regexp_extract(c, r"(?i)\b(" + "|".join(R.ENGLISH_PHRASES) + r")\b", 1)
    mixed = F.regexp_extract(c, r"(?i)(?<![A-Za-zÀ-ÿ])(I(?:-(?=[a-zà-ÿ])|\s+(?=[a-zà-ÿ]))|Y-you\b)", 1)
    return F.coalesce(*[F.when(x != "", x) for x in (token, phrase, mixed)])


def leaking_sentences(c: Column) -> Column:
    """The sentences of a text that read as English, or a single word or phrase that tells of it."""
    quick = english_quick_leak(c)
    long = F.filter(F.transform(F.split(c, SENTENCE, -1), T.strip), _reads_english)
    return F.when(quick.isNotNull(), F.array(quick)).otherwise(long)


def _reads_english(sentence: Column) -> Column:
    words = F.transform(F.regexp_extract_all(sentence, F.lit(r"([A-Za-z]+(?:['’][A-Za-z]+)?)"), 1), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))

    def judged(w: Column) -> Column:
        n = F.size(w)
        en = F.size(F.filter(w, lambda x: x.isin(R.ENGLISH_WORDS))) + 2 * F.regexp_count(sentence, F.lit("(?i)" + R.ENGLISH_CONTRACTIONS)) + F.regexp_count(sentence, F.lit(R.ENGLISH_POSSESSIVE))
        pt = F.size(F.filter(w, lambda x: x.isin(R.PORTUGUESE_WORDS)))
        return (n >= 6) & (((n >= 10) & (en >= 5) & (en / n >= 0.25)) | ((en >= 4) & (en >= pt + 2)))

    return (F.length(sentence) >= 35) & T.let(words, judged)


#: Languages other than English whose residue is known.
RESIDUAL_CODES = [c for c, _ in R.RESIDUAL_SCRIPTS] + [c for c, _ in R.RESIDUAL_WORDS]


def leak_segments(c: Column, language: str) -> Column:
    """What of a text is still in the source's language: runs of its script, or sentences with two or more of its words."""
    if language == "en":
        return leaking_sentences(c)
    if pattern := dict(R.RESIDUAL_SCRIPTS).get(language):
        return F.regexp_extract_all(c, F.lit(pattern), 0)
    marks = dict(R.RESIDUAL_WORDS).get(language, "").split()
    return F.transform(F.filter(F.split(c, SENTENCE, -1), lambda x: F.size(F.filter(T.words_of(x), lambda w: w.isin(marks))) >= 2), T.strip)


def residual_preview(c: Column, language: str) -> Column:
    """The first leaking segment, 80 characters of it at most, or null."""
    first = T.squeeze(F.get(leak_segments(c, language), F.lit(0)))
    return T.let(first, lambda x: F.when(F.length(x) > 80, F.concat(F.rtrim(F.substring(x, 1, 77)), F.lit("..."))).otherwise(x))


def residual_reason(c: Column, language: str) -> Column:
    """Why a text counts as still in the source's language, with the first place, or null."""
    prefix = "residual_english:" if language == "en" else f"residual_source_language:{language}:"
    return F.concat(F.lit(prefix), residual_preview(c, language))


def source_leaks(docs: DataFrame, language: str) -> DataFrame:
    """(doc_id, n): how many segments are still in the source's language, of documents that have any."""
    return docs.select("doc_id", F.size(leak_segments(F.col("text"), language)).cast("bigint").alias("n")).filter("n > 0")


def refine_repetition(c: Column) -> Column:
    """As ``suspicious_repetition``, by tokens between spaces, and with a paragraph three times as a fourth sign."""
    tokens = F.filter(F.split(T.squeeze(c), " "), lambda x: x != "")
    few = (F.size(tokens) >= 40) & (F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)) < 0.25)
    sentences = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+", -1), T.strip), lambda s: s != "")
    again = (max_count(sentences) >= 3).cast("int") + (max_count(T.paragraphs(c)) >= 3).cast("int")
    return long_repeat()(c).cast("int") + few.cast("int") + again >= 2


def has_refine_noise(c: Column) -> Column:
    return T.contains_any(F.lower(c), R.META_REFINE)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(hash16, n, first_doc) of texts that more than one document has."""
    return docs.groupBy(T.chunk_hash(F.col("text")).alias("hash16")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def top_words(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, rank, word, n) of each document's commonest words; ties by the alphabet."""
    rows = docs.select("doc_id", F.explode(T.words_of(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "word")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("doc_id", "rank", "word", "n")
