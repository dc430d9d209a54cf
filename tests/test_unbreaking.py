"""An unbroken answer is judged by plain searches, and lines are made only where a text needs them: the same results by less work."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import rewrite as W
from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import model as M


def _texts(pieces, n=400, most=14):
    r = random.Random(11)
    return ["", *["".join(r.choices(pieces, k=r.randint(1, most))) for _ in range(n)]]


PIECES = ["a", "Bê", "x", "-", "-\n", "\n", "\n\n", " ", "\xa0", '"', "“", "”", "'''", '"""', "***", "...", "..", "…", "\r\n", "\x0b", "\x1c", " ", "\x1f", "1", "😀"]


def _plan(spark, c):
    return spark.createDataFrame([("a",)], "t string").select(c)._jdf.queryExecution().analyzed().toString()


def test_answers_are_made_as_by_lines_and_patterns_alone(spark):
    t = F.col("t")
    lone = lambda c, these: F.exists(T.lines(c), lambda x: T.strip(x).isin(*these))
    plain = F.array_join(F.filter(T.lines(W.unwrap_triple_quotes(t)), lambda x: ~T.strip(x).isin(*W.LONELY_ANSWER)), "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, "(?U)(\\w)-\\s*\\n\\s*(\\w)", "$1-$2"), "\\b([A-Za-zÀ-ÿ])-\\s+([A-Za-zÀ-ÿ])", "$1-$2")
    texts = [*_texts(PIECES), *_texts([x for x in PIECES if x in "\n\n" or x not in T.BREAKS and x != "\r\n"], 1200), *_texts(["***", "\n", " ", "a", "-"], 300)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    stars = lambda c: F.regexp_replace(F.array_join(F.transform(T.lines(c), lambda x: F.when(T.strip(x) == "***", "\n***\n").otherwise(x)), "\n"), "\n{3,}", "\n\n")
    pairs = ((W.unbreak_output(t), stars(plain)), (W.isolate_stars(t), stars(t)), (T.has_line(t, W.LONELY), lone(t, W.LONELY)), (T.has_line(t, W.LONELY_ANSWER), lone(t, W.LONELY_ANSWER)), (T.occurrences(t, "...", "…"), F.regexp_count(t, F.lit("\\.\\.\\.|…"))))
    out = rows.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert [r.t for r in out if any(r[f"p{i}"].a != r[f"p{i}"].b for i in range(len(pairs)))] == []
    assert len({r.p2.a for r in out}) == len({r.p3.a for r in out}) == 2


def test_judgements_are_those_of_patterns_without_counting_by_them(spark):
    texts = _texts(["a", "é", "1", "²", "_", " ", "\n", '"', "“", "”", "...", "…", "-"])
    rows = spark.createDataFrame(list(zip(texts, texts[1:] + texts[:1], strict=True)), "b string, a string")
    n = lambda pattern, x: len(re.findall(pattern, x))
    letters = lambda x: sum(c.isalnum() for c in x)

    def problems(b, a):
        lost = letters(b) > 0 and letters(a) < letters(b) * 0.99
        told = (("lonely_quote_line", any(x.strip() in W.LONELY for x in a.splitlines())), ("ellipsis_mismatch", n(r"\.\.\.|…", a) != n(r"\.\.\.|…", b)), ("alnum_loss", lost))
        return [name for name, there in told if there]

    def inflated(b, a):
        m, k = n("[\"“”]", a), n("[\"“”]", b)
        return m > k and m >= k * 1.5 and m - k >= 4

    out = rows.select("b", "a", W.reflow_problems(F.col("b"), F.col("a")).alias("p"), T.quote_inflation(F.col("b"), F.col("a")).alias("q")).collect()
    assert [(r.b, r.a) for r in out if r.p != problems(r.b, r.a) or r.q != inflated(r.b, r.a)] == [] and any(r.q for r in out)
    plan = _plan(spark, F.struct(W.reflow_problems(F.col("t"), F.upper("t")), T.quote_inflation(F.col("t"), F.upper("t")), W.isolate_stars(F.lower("t"))))
    assert "regexp_count" not in plan and plan.count("lower(t#") == 1


def test_only_what_needs_it_is_reflowed(spark, monkeypatch):
    """A chunk's text goes to the rules only if its answer has quotes that it should not have."""
    seen = []

    def rewritten(docs, f, counters, inputs=("text",), into="text"):
        if into == "reflowed":
            seen.extend(docs.select(*inputs).collect())
        return real(docs, f, counters, inputs, into)

    class Quoting:
        def generate(self, prompt, attempt):
            text = prompt.partition('TEXT:\n"""')[2].removesuffix('"""')
            return text + '\n"' if text.startswith("b") else text

    real = M.rewritten
    monkeypatch.setattr(M, "rewritten", rewritten)
    docs = spark.createDataFrame([(1, "aa bb\ncc dd."), (2, "bb cc\nand dd.")], "doc_id bigint, text string")
    out = {r.doc_id: (r.text, r.fallbacks) for r in M.unbreak(spark, docs, Quoting()).collect()}
    assert out == {1: ("aa bb cc dd.", 0), 2: ("bb cc and dd.", 1)}
    assert sorted(x[0] or "" for x in seen) == ["", "bb cc\nand dd."]


def test_the_stub_turns_words_as_letter_by_letter():
    def slowly(text):
        out = []
        for c in text:
            if out and c.isalpha() and out[-1][-1].isalpha():
                out[-1] += c
            else:
                out.append(c)
        return "".join(w[::-1] if w.isalpha() and w.islower() else w for w in out)

    texts = _texts(["ab", "C", "é", "ª", "²", "½", "Ⅷ", "7", "_", " ", "ß", "语", "é", "ǆ", "\n"], 2000, 8)
    assert [M.StubBackend().generate(x, 1) for x in texts if x] == [slowly(x) for x in texts if x]


def test_hyphens_are_sought_only_behind_a_sign():
    word = re.compile(r"\b([A-Za-z]{2,})-([A-Za-z]{2,})\b")
    for x in _texts(["ab", "cd", "abcd", "-", " ", "é", "1", "_"], 2000, 12):
        assert bool(word.search(x)) <= bool(re.search("-[A-Za-z]{2}", x))
    assert prose.dominant_hyphens("abcd abcd abcd ab-cd") == ("abcd abcd abcd abcd", 1)
    assert R.HYPHEN_PREFIXES
