"""Rules over lines look at no more of a line than decides, and books are made without patterns: the same results by less work."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.plans import books as B


def _texts():
    r = random.Random(7)
    parts = ["Ana", "de", "dA", "Óbidos", "ß", "øre", "x", " ", "  ", "\xa0", "\x1c", "　", "—", "1", "-", "!", ".", "E", "uma", " que ", "Éa", "d", "do", "dos", "dosa"]
    return ["", " ", "a b c d e f", "a b c d e f g", "Ana\xa0de　Óbidos", *["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(400)]]


def _values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_a_name_is_told_without_its_words_being_listed(spark):
    texts = _texts()
    words = [re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]+", t) for t in texts]
    name = [bool(w) and all(x[0].isupper() or x.lower() in R.NAME_CONNECTORS for x in w) for w in words]
    assert _values(spark, texts, T.looks_like_name) == name and any(name)
    plan = spark.createDataFrame([("a",)], "t string").select(T.looks_like_name(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan


def test_words_are_counted_no_further_than_asked(spark):
    texts = [t.strip() for t in _texts()]
    assert _values(spark, texts, lambda c: T.few_words(c, 6)) == [len(re.split(r"\s+", t)) <= 6 for t in texts]


def test_an_attribution_is_taken_out_of_a_line_once(spark):
    rows = spark.createDataFrame([("— disse Ana.",), ("—",), ("— ela disse.",), ("disse",), (None,), (" — Ana Sá respondeu: sim",)], "t string").select(T.attribution(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == ["disse Ana.", None, None, None, None, "Ana Sá respondeu: sim"]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 1


def test_noise_is_found_wherever_its_patterns_hold(spark):
    texts = ["see http://x", "HTTPS://X", "www.a", "a.example", "a.test/", "b.invalid?", ".example", "a.examples", "- Chapter 12 -", "chapter", "Title Page.", "Prologue", "a prologue", "12", "12345"]
    noise = lambda t: bool(re.search(R.AUDIT_URL, t) or re.search(R.AUDIT_CONTENTS, re.sub("^[ .:-]+|[ .:-]+$", "", t)) or re.fullmatch(r"\d{1,4}", t.strip()))
    assert _values(spark, texts, T.is_obvious_noise) == [noise(t.lower()) for t in texts]


def test_books_are_made_without_patterns(spark):
    texts = ["\nThe. On. To, a that that que \nAnd\n\nOh. Is", " la la  la ", "", None, "x. Of. An. Re\nWe\nNo\nRa und und "]
    want = []
    for t in texts:
        for pattern, by in B.RULES if t else ():
            t = re.sub(pattern, by.replace("\\", r"\\"), t)
        want.append(t)
    assert _values(spark, texts, B.book) == want
    assert "regexp" not in spark.createDataFrame([("a",)], "t string").select(B.book(F.col("t")))._jdf.queryExecution().analyzed().toString()
