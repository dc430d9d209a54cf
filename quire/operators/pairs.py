"""Checks of a (source, target) pair: regressions of quotes and structure, mutations, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import detect as D
from quire.operators import glossary as G

MALFORMED = "”[ \\t]*“(?=[A-Za-zÀ-ÿ])"
SLASH = r"(?<![\w/])([A-Za-zÀ-ÿ]+/[A-Za-zÀ-ÿ]+)(?![\w/])"


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, source, target): a user's turn and the assistant's answer after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"next_role": F.lead("role").over(order), "target": F.lead("text").over(order)})
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


def entities(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)(" + R.ENTITY + ")"), 1)


def semantic_drift(source: Column, target: Column) -> Column:
    a, b = entities(source), entities(target)
    shared = F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))
    return (F.size(a) > 0) & ((shared / F.greatest(F.size(a), F.lit(1)) < 0.6) | (F.size(b) > F.size(a) + 5))


def entity_mutation(source: Column, target: Column) -> Column:
    """A name that the source has twice comes back longer, as Mara does in Maramente."""
    stable = lambda a: F.filter(F.array_distinct(a), lambda e: (F.length(e) >= 4) & (F.size(F.filter(a, lambda x: x == e)) >= 2))
    longer = lambda t, e: F.startswith(t, F.substring(e, 1, 3)) & (F.length(t) >= F.length(e) + 2)
    mutated = lambda fresh, kept: F.exists(fresh, lambda t: F.exists(kept, lambda e: longer(t, e)))
    names = lambda c: F.transform(entities(c), F.lower)
    return T.let(names(source), lambda a: T.let(stable(a), lambda kept: mutated(F.array_except(names(target), a), kept)))


def slash_mutation(source: Column, target: Column) -> Column:
    tokens = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?U)" + SLASH), 1), F.lower)
    found = F.size(F.array_except(tokens(target), tokens(source))) > 0
    return F.when(source.isNotNull() & ~F.contains(target, F.lit("/")), F.lit(False)).otherwise(found)


def reuse_safe(a: Column, b: Column, most_delta: float = 0.15) -> Column:
    """Whether one text's result may serve the other: near in length, equal numbers, equal names."""
    longest = F.greatest(F.length(a), F.length(b))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(" + R.NAME + ")"), 1), F.lower)))
    na, nb = names(a), names(b)
    return (a != "") & (b != "") & (F.abs(F.length(a) - F.length(b)) <= longest * most_delta) & (numbers(a) == numbers(b)) & ((F.size(na) == 0) | (F.size(nb) == 0) | (na == nb))


def curly(c: Column) -> tuple[Column, Column]:
    return T.count_of(c, "“"), T.count_of(c, "”")


def single_pair_repair(source: Column, target: Column) -> Column:
    """The target has one pair of quotes more, which mends a line that the source closes without opening it."""
    (so, sc), (to, tc) = curly(source), curly(target)
    return (so > 0) & (so == sc) & (to == tc) & (to + tc == so + sc + 2) & T.closed_unopened(source)


def missing_open_repair(source: Column, target: Column) -> Column:
    """The target has the one opening quote that the source lacks."""
    (so, sc), (to, tc) = curly(source), curly(target)
    return (sc == so + 1) & (to == so + 1) & (tc == sc) & T.closed_unopened(source)


def balance_regression(source: Column, target: Column) -> Column:
    """The target leaves another number of speeches open than the source; with straight quotes only parity is compared."""
    (so, sc), (to, tc) = curly(source), curly(target)
    straight = lambda c: T.count_of(c, '"')
    only_source = F.when(straight(target) > 0, (so + sc) % 2 != straight(target) % 2).otherwise(so != sc)
    both = ((so - sc) != (to - tc)) & ~missing_open_repair(source, target)
    return F.when((so + sc > 0) & (to + tc > 0), both).when(so + sc > 0, only_source).when(to + tc > 0, straight(source) % 2 != (to + tc) % 2).otherwise(F.lit(False))


def count_regression(source: Column, target: Column) -> Column:
    """The target has more curly quotes than a source that has some, and mends nothing by it."""
    (so, sc), (to, tc) = curly(source), curly(target)
    return (so + sc > 0) & (to + tc > so + sc) & ~(single_pair_repair(source, target) | missing_open_repair(source, target))


def short_repetition(source: Column, target: Column) -> Column:
    """Short lines repeat more than they do in the source."""
    return D.short_line_peak(target) >= F.greatest(F.lit(3), D.short_line_peak(source) + 2)


def retry_reason(source: Column, target: Column) -> Column:
    """The first reason to ask for another target; an empty string if there is none."""
    iq, oq = T.count_quotes(source), T.count_quotes(target)
    il, ol = T.quote_lines(source), T.quote_lines(target)
    ip, op = T.count_paragraphs(source), T.count_paragraphs(target)
    ratio = F.length(T.strip(target)) / F.greatest(F.length(T.strip(source)), F.lit(1))
    dots = lambda c: F.regexp_count(c, F.lit(r"\.\.\.|…"))
    paras = F.filter(F.transform(F.split(target, r"\n{2,}", -1), T.strip), lambda p: p != "")
    low = lambda p: p.rlike("^[a-zà-ÿ]")
    cases = [
        (target.rlike(MALFORMED), "malformed_quote_boundary"),
        (balance_regression(source, target), "unbalanced_quotes"),
        (count_regression(source, target), "extra_curly_quotes"),
        (((iq % 2 != oq % 2) | ((iq > 0) & (oq > iq + 4))) & ~single_pair_repair(source, target) & ~missing_open_repair(source, target), "unbalanced_quotes_straight"),
        ((iq >= 4) & (oq < iq - 2), "dialogue_quotes_lost"),
        ((il >= 2) & (ol < F.greatest(F.lit(1), il - 1)), "dialogue_lines_lost"),
        (T.strip(target) == "", "empty_output"),
        ((ip >= 2) & (op < ip) & (F.size(T.nonblank_lines(target)) < ip), "paragraphs_lost"),
        (target.rlike(r"[A-Za-zÀ-ÿ](?:\.\.\.|…)[A-Za-zÀ-ÿ]"), "ellipsis_in_word"),
        ((F.size(paras) > 1) & F.exists(paras, lambda p: (F.length(p) <= 30) & low(p)), "lowercased_fragment"),
        (F.exists(paras, low), "lowercase_narration_start"),
        (T.strip(target).rlike(r"(?:^|\s)[A-Za-zÀ-ÿ]{1,4}(?:\.{3}|…)\s*$"), "truncated_token_ellipsis"),
        ((dots(source) == 0) & (dots(target) >= 2) & ((F.length(target) < 500) | (dots(target) / F.greatest(F.length(target), F.lit(1)) > 0.01)), "ellipsis_suspect"),
        (short_repetition(source, target), "extra_short_repetition"),
        (ratio < 0.6, "truncated"),
        (ratio > 1.8, "too_long"),
        (D.suspicious_repetition(target), "suspicious_repetition"),
        (T.has_meta_noise(target), "meta_noise"),
    ]
    out = F.lit("")
    for test, reason in reversed(cases):
        out = F.when(test, reason).otherwise(out)
    return out


def issues(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, type, term, found) over pairs (pair_id, source, target) and a glossary.

    Pairs meet only the terms of which some form is in their source or target.
    """
    terms = glossary.select("key", "pt", F.array_distinct(F.filter(F.concat(F.array("key"), F.coalesce("source_aliases", F.array())), lambda x: x != "")).alias("variants"), F.coalesce("bad_aliases", F.array()).alias("bad"), F.coalesce("allowed_target_aliases", F.array()).alias("allowed"), F.coalesce("enforce", F.lit(False)).alias("enforce"))
    forms = terms.select("key", F.explode(F.array_distinct(F.concat("variants", "bad"))).alias("form"))
    met = G.term_hits(pairs.select("pair_id", F.concat_ws("\n", "source", "target").alias("text")), forms, "pair_id").select("pair_id", "key").distinct()
    both = pairs.join(met, "pair_id").join(terms, "key")
    s, t, low = F.col("source"), F.col("target"), lambda a: F.transform(a, F.lower)
    bad = F.filter("bad", lambda b: T.term_contains(t, b, F.lower(b) == F.lower("pt")))
    leaked = F.filter("variants", lambda v: (v != F.col("pt")) & ~T.term_contains(F.col("pt"), v) & ~F.array_contains(low(F.col("allowed")), F.lower(v)) & T.term_contains(t, v))
    named = T.term_contains(s, F.col("key"))
    needed = F.when(F.col("enforce"), F.exists("variants", lambda v: T.term_contains(s, v))).otherwise(named)
    missing = needed & ~T.term_contains(t, F.col("pt")) & ~F.exists("allowed", lambda a: T.term_contains(t, a))
    row = lambda kind, found: F.struct(F.lit(kind).alias("type"), F.col("key").alias("term"), found.alias("found"))
    translated = F.col("key") != F.col("pt")
    found = F.concat(
        F.transform(bad, lambda b: row("bad_alias_in_target", b)),
        F.when(translated, F.transform(leaked, lambda v: row("source_term_in_target", v))).otherwise(F.array()),
        F.when(translated & missing, F.array(row("missing_canonical_term", F.lit("")))).otherwise(F.array()),
    )
    glossed = both.select("pair_id", F.explode(found).alias("i")).select("pair_id", "i.type", "i.term", "i.found")
    row = lambda kind, found: F.struct(F.lit(kind).alias("type"), F.lit("").alias("term"), found.alias("found"))
    leaks = F.transform(F.filter(F.array(*map(F.lit, R.SOURCE_LEAKS)), lambda p: T.term_contains(t, p)), lambda p: row("residual_english", p))
    meta = F.transform(F.regexp_extract_all(t, F.lit(R.ENGLISH_META), 1), lambda m: row("english_meta_text", m))
    mixed = F.flatten(F.transform(sentences(t), lambda x: F.filter(F.array(*[F.when(x.rlike("(?is)" + p), row("possible_gender_mismatch", F.lit(label))) for p, label in R.MIXED_GENDERS]), lambda y: y.isNotNull())))
    one = lambda test, kind, found="": F.when(test, row(kind, found if isinstance(found, Column) else F.lit(found)))
    language = T.detect_language(s)
    residue = F.array(*[F.when(language == code, row("residual_source_language", D.residual_preview(t, code))) for code in D.RESIDUAL_CODES])
    opens, closes = curly(t)
    shape = F.array(
        one(t.rlike(R.MARKERS), "residual_translation_marker"),
        one(F.regexp_count(t, F.lit('"')) % 2 == 1, "unbalanced_quotes", '"'),
        one(opens != closes, "unbalanced_quotes", "“/”"),
        one(t.rlike(MALFORMED), "malformed_quote_boundary", "”“"),
        one(t.rlike(STRAY), "stray_format_marker", F.regexp_extract(t, STRAY, 1)),
        one(t.rlike(GLUED_QUOTES), "missing_quote_spacing"),
    )
    plain = F.filter(F.concat(leaks, meta, mixed, residue, shape), lambda x: x.isNotNull() & x["found"].isNotNull())
    plain = pairs.select("pair_id", F.explode(plain).alias("i")).select("pair_id", "i.type", "i.term", "i.found")
    return glossed.unionByName(plain).unionByName(gender_issues(pairs, glossary))


#: A speech's end with a star behind it, and quotes that stand at a speech or a sentence without a space.
STRAY = "([.!?…][”\"]\\*)(?=\\s|$)"
GLUED_QUOTES = "[”\"](?=[“\"])|[.!?…](?=[“\"][A-Za-zÀ-ÿ])"


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?…])\s+|\n+", -1), lambda x: T.strip(x) != "")


def gender_issues(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, type, term, found): a person of known gender said to be something of the other, a sentence each."""
    gender = F.lower(T.strip(F.col("gender")))
    people = glossary.filter((F.lower(T.strip(F.col("category"))) == "personagem") & gender.isin("feminino", "masculino"))
    parts = F.filter(F.split("pt", r"\s+"), lambda p: F.length(p) > 3)
    people = people.select("key", gender.alias("gender"), F.array_distinct(F.concat(F.array("pt", "key"), F.when(F.contains("pt", F.lit(" ")), parts).otherwise(F.array().cast("array<string>")))).alias("names"))
    met = G.term_hits(pairs.select("pair_id", F.col("target").alias("text")), people.select("key", F.explode("names").alias("form")), "pair_id").select("pair_id", "key").distinct()
    rows = pairs.join(met, "pair_id").join(people, "key").select("pair_id", "key", "gender", "names", F.posexplode(sentences(F.col("target"))).alias("no", "sentence"))
    words = F.when(F.col("gender") == "feminino", "|".join(R.MASCULINE_WORDS)).otherwise("|".join(R.FEMININE_WORDS))
    quoted = lambda n: F.regexp_replace(n, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    pattern = lambda n: F.concat(F.lit("(?iu)\\b"), quoted(n), F.lit(r"\b\s+" + R.BEING + R.DEGREE + r"\s+("), words, F.lit(r")\b"))
    said = F.filter(F.transform(F.filter("names", lambda n: n != ""), lambda n: F.get(F.regexp_extract_all("sentence", pattern(n), F.lit(1)), F.lit(0))), lambda x: x.isNotNull())
    return rows.withColumn("found", F.get(said, F.lit(0))).filter("found is not null").select("pair_id", F.lit("possible_gender_mismatch").alias("type"), F.col("key").alias("term"), "found")


def scores(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(pair_id, score, issue_count): 100 less the penalties, 0 at least."""
    penalty = F.lit(R.OTHER_PENALTY)
    for kind, n in R.PENALTIES:
        penalty = F.when(F.col("type") == kind, n).otherwise(penalty)
    sums = found.groupBy("pair_id").agg(F.sum(penalty).alias("p"), F.count("*").alias("n"))
    out = pairs.select("pair_id").join(sums, "pair_id", "left")
    return out.select("pair_id", F.greatest(F.lit(0), 100 - F.coalesce("p", F.lit(0))).cast("bigint").alias("score"), F.coalesce("n", F.lit(0)).alias("issue_count"))
