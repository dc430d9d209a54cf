"""Review of translations by a glossary: forbidden forms, names in capitals, doubled names, articles; headings; reports.

A text meets only the terms of which some form stands in it (``glossary.term_hits``); these reach its row, and the rules
go over the row in Python, for each of them sees what the one before has changed.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from quire.functions import prose
from quire.functions import rewrite as W
from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import glossary as G
from quire.operators import pairs as P
from quire.operators import quotes as Q
from quire.operators.rows import rewritten

TERM = ("key", "pt", "category", "gender", "source_aliases", "bad_aliases", "allowed_target_aliases", "target_replacements")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def in_category(term: dict, kinds: tuple[str, ...]) -> bool:
    found = (term.get("category") or "").strip().casefold()
    return any(k in found for k in kinds)


def is_name(value: str) -> bool:
    words = re.findall(f"[{LETTER}]+", value)
    return bool(words) and all(w[0].isupper() or w.casefold() in R.NAME_CONNECTORS for w in words)


def widest(forms) -> list[str]:
    """The forms without blanks and repeats in any case, the longest first."""
    first: dict[str, str] = {}
    for f in (x.strip() for x in forms if x and x.strip()):
        first.setdefault(f.casefold(), f)
    return sorted(first.values(), key=len, reverse=True)


def names_of(term: dict) -> list[str]:
    """The proper names that a term stands for, and their parts where these are names of their own."""
    key, pt = term["key"].strip(), term["pt"].strip()
    forms = [pt, key, *(term.get("source_aliases") or ()), *(term.get("allowed_target_aliases") or ())]
    if in_category(term, R.PART_CATEGORIES) and key.casefold() == pt.casefold() and is_name(pt):
        forms += [p for p in pt.split() if len(p) >= 3 and p[0].isupper()]
    return [f for f in widest(forms) if len(f) >= 3 and is_name(f)]


def article_forms(term: dict) -> list[str]:
    """The forms before which a term's article is looked at: names, parts and aliases."""
    parts = [p for name in (term["pt"], term["key"]) for p in name.split() if len(p) >= 3 and p[0].isupper()]
    return widest([term["pt"], term["key"], *parts, *(term.get("source_aliases") or ()), *(term.get("allowed_target_aliases") or ())])


class Review:
    """A text under review, with what was replaced."""

    def __init__(self, text: str):
        self.text, self.counts = text, Counter()

    def put(self, pattern: str, by: str, label: str, flags: int = 0) -> int:
        self.text, n = re.subn(pattern, lambda m: by, self.text, flags=flags)
        if n:
            self.counts[label] += n
        return n

    def editorial(self) -> None:
        for pattern, by, keeps_case in R.EDITORIAL:

            def cased(m: re.Match, by: str = by, keeps_case: bool = keeps_case) -> str:
                if not keeps_case or m[0].islower():
                    return by
                return by.upper() if m[0].isupper() else by[0].upper() + by[1:] if m[0][0].isupper() else by

            self.text, n = re.subn(pattern, cased, self.text, flags=re.I)
            if n:
                self.counts[f"{pattern}->{by}"] += n

    def aliases(self, term: dict) -> None:
        """Forbidden forms made the canonical one; forms that differ in case alone are looked for in their case."""
        pt = term["pt"].strip()
        swaps = [(a.strip(), b.strip(), re.I) for a, b in (term.get("target_replacements") or ()) if a.strip() and b and b.strip()]
        swaps += [(a.strip(), pt, 0 if a.strip().casefold() == pt.casefold() else re.I) for a in term.get("bad_aliases") or () if a.strip() and a.strip() != pt]
        for form, by, flags in swaps:
            self.put(rf"(?<!\w){re.escape(form)}(?!\w)", by, f"{form}->{by}", flags)

    def capitals(self, term: dict) -> None:
        """A name all in capitals as it is written."""
        for name in names_of(term) if in_category(term, R.ENTITY_CATEGORIES) else ():
            if name.upper() != name:
                self.put(f"(?<![{LETTER}]){re.escape(name.upper())}(?![{LETTER}])", name, f"{name.upper()}->{name}")

    def doubled(self, term: dict) -> None:
        """First First Last, First Last Last and First Last First Last made First Last."""
        pt = term["pt"].strip()
        parts = pt.split()
        if len(parts) < 2 or term["key"].strip().casefold() != pt.casefold() or not in_category(term, R.PERSON_CATEGORIES):
            return
        whole = re.escape(pt)
        forms = [rf"{re.escape(parts[0])}\s+{whole}", rf"{whole}\s+{re.escape(parts[-1])}", rf"{whole}\s+{whole}"]
        for _ in range(3):
            if not sum(self.put(rf"(?<!\w){form}(?!\w)", pt, f"doubled {pt}", re.I) for form in forms):
                return

    def articles(self, term: dict) -> None:
        """Articles and ally of a person's gender."""
        gender = (term.get("gender") or "").strip().casefold()
        if not gender.startswith(("femin", "mascul")) or not in_category(term, R.GENDERED_CATEGORIES):
            return
        feminine = gender.startswith("femin")
        wrong, right = ("aliado", "aliada") if feminine else ("aliada", "aliado")
        for form in article_forms(term):
            for masculine_article, feminine_article in R.ARTICLES:
                old, new = (masculine_article, feminine_article) if feminine else (feminine_article, masculine_article)
                self.put(rf"\b{old}\s+{re.escape(form)}\b", f"{new} {form}", f"{old} {form}->{new} {form}")
            self.put(rf"\b{re.escape(form)} como {wrong}\b", f"{form} como {right}", f"{form} como {wrong}->{right}")


def reviewed(text: str, terms: list[dict]) -> tuple[str, Counter]:
    """Editorial replacements, then all terms' forbidden forms, capitals, doubled names and articles, in this order."""
    r = Review(text)
    r.editorial()
    for rule in (r.aliases, r.capitals, r.doubled, r.articles):
        for term in terms:
            rule(term)
    return r.text, r.counts


def review_forms(glossary: DataFrame) -> DataFrame:
    """(key, form) of all that the review looks for of a term."""
    replaced = F.map_keys(F.coalesce("target_replacements", F.create_map().cast("map<string,string>"))) if "target_replacements" in glossary.columns else F.array().cast("array<string>")
    lists = [F.coalesce(c, F.array()) for c in ("source_aliases", "bad_aliases", "allowed_target_aliases")]
    whole = F.array_distinct(F.concat(F.array("key", "pt"), *lists, replaced))
    parts = F.filter(F.flatten(F.transform(F.array("key", "pt"), lambda x: F.split(x, r"\s+"))), lambda x: F.length(x) >= 3)
    return glossary.select("key", F.explode(F.array_distinct(F.concat(whole, parts))).alias("form")).filter(T.strip(F.col("form")) != "")


def review(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, text, replaced): ``replaced`` a map of what was replaced and how often."""
    g = glossary if "target_replacements" in glossary.columns else glossary.withColumn("target_replacements", F.lit(None).cast("map<string,string>"))
    hits = G.term_hits(texts.select("doc_id", "text"), review_forms(g), "doc_id").select("doc_id", "key").distinct()
    rows = g.select("pos", *TERM[:-1], F.map_entries("target_replacements").alias("target_replacements"))
    terms = hits.join(rows, "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *TERM))).alias("terms"))
    both = texts.select("doc_id", "text").join(terms, "doc_id", "left").select("doc_id", "text", "terms")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("replaced", MapType(StringType(), LongType()))])
    return both.mapInPandas(_review, schema)


def _review(frames):
    for frame in frames:
        done = [reviewed(t or "", [_plain(x) for x in terms] if terms is not None else []) for t, terms in zip(frame["text"], frame["terms"], strict=True)]
        yield frame[["doc_id"]].assign(text=[t for t, _ in done], replaced=[dict(c) for _, c in done])


def _plain(term) -> dict:
    """A term of a pandas row as a dict; replacements as pairs."""
    t = term if isinstance(term, dict) else term.asDict(recursive=True)
    pairs = t.get("target_replacements")
    out = {k: (list(v) if k.endswith("aliases") and v is not None else v) for k, v in t.items()}
    out["target_replacements"] = [((p["key"], p["value"]) if isinstance(p, dict) else (p[0], p[1])) for p in pairs] if pairs is not None else []
    return out


def restore_headings(c: Column, titles: Column) -> Column:
    """The heading of a prologue that the sections have, set before a text of which no paragraph begins with it."""
    paragraphs = F.filter(F.transform(F.split(T.strip(c), r"\n\s*\n", -1), T.strip), lambda p: p != "")
    heads = F.transform(paragraphs, lambda p: T.strip(F.substring_index(p, "\n", 1)))
    told = F.exists(titles, lambda t: F.lower(T.strip(t)) == "prologue")
    there = F.exists(heads, lambda h: h.rlike("(?iu)^#?\\s*prólogo\\s*$"))
    put = F.when(told & ~there, F.concat(F.array(F.lit("# Prólogo")), paragraphs)).otherwise(paragraphs)
    return F.when(F.size(titles) > 0, F.array_join(put, "\n\n")).otherwise(c)


def _normal(rows: DataFrame) -> DataFrame:
    return rewritten(rows.withColumn("text", W.final_postprocess(F.col("text"))), lambda t: (prose.structured(t), 0), ["none"]).drop("none")


def finalized(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, text, balanced, speeches) of pairs (pair_id, source, target): normalised, reviewed, normalised, quotes set.

    ``report`` of the result with its source gives the checks and the score.
    """
    rows = _normal(pairs.select(F.col("pair_id").alias("doc_id"), F.col("target").alias("text")))
    rows = _normal(review(rows, glossary).select("doc_id", "text"))
    rows = rewritten(rows, Q.balance, ["balanced"])
    moved = F.regexp_replace("text", "(?m)([^\\n])\\n(?:[ \\t]*\\n)+[ \\t]*”(?=“)", "$1”\n\n")
    rows = rows.withColumn("text", F.when(F.col("balanced") > 0, moved).otherwise(F.col("text")))
    rows = rewritten(_normal(rows), Q.join_broken_speech, ["speeches"])
    return rows.select(F.col("doc_id").alias("pair_id"), "text", "balanced", "speeches")


def report(pairs: DataFrame, glossary: DataFrame, most: int = R.MOST_ISSUES) -> DataFrame:
    """(pair_id, source_language, score, issue_count, by_type, issues, truncated) of pairs; ``most`` issues are shown, all count."""
    found = P.issues(pairs, glossary)
    kinds = found.groupBy("pair_id", "type").agg(F.count("*").alias("n")).groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    shown = found.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("type", "term", "found"))).alias("all"))
    out = P.scores(pairs, found).join(kinds, "pair_id", "left").join(shown, "pair_id", "left").join(pairs.select("pair_id", T.detect_language(F.col("source")).alias("source_language")), "pair_id")
    none = F.create_map().cast("map<string,bigint>")
    issues = F.coalesce("all", F.array().cast("array<struct<type:string,term:string,found:string>>"))
    return out.select("pair_id", "source_language", "score", "issue_count", F.coalesce("by_type", none).alias("by_type"), F.slice(issues, 1, most).alias("issues"), (F.size(issues) > most).alias("truncated"))
