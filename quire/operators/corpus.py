"""Checks across volumes: terms, pronouns, voices and events that do not agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import glossary as G


def volumes(docs: DataFrame, key: Column) -> DataFrame:
    """(volume_key, doc_id, text): a volume is its documents; counts are added, not texts."""
    return docs.select(key.alias("volume_key"), "doc_id", "text")


def term_inconsistency(terms: DataFrame) -> DataFrame:
    """(key, n_pt, variants, volumes) of keys that volumes (``source``) translate differently."""
    rows = terms.filter((T.strip(F.col("key")) != "") & (T.strip(F.col("pt")) != ""))
    out = rows.groupBy("key").agg(F.array_sort(F.collect_set("pt")).alias("v"), F.array_sort(F.collect_set("source")).alias("s"))
    return out.filter(F.size("v") > 1).select("key", F.size("v").cast("bigint").alias("n_pt"), F.array_join("v", "|").alias("variants"), F.array_join("s", "|").alias("volumes"))


def registry(terms: DataFrame) -> DataFrame:
    """(key, pt, aliases, gender) of persons."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    gender = F.when(T.contains_any(notes, R.FEMININE_NOTES), "F").when(T.contains_any(notes, R.MASCULINE_NOTES), "M")
    rows = terms.filter(F.lower("category") == "personagem").withColumn("g", gender)
    return rows.groupBy("key").agg(F.min_by("pt", "pos").alias("pt"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_aliases", F.array()))))).alias("aliases"), F.min_by("g", F.when(F.col("g").isNotNull(), F.col("pos"))).alias("gender"))


def pronouns(c: Column, words) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.regexp_count(c, F.lit(rf"(?iu)\b{w}\b"))
    return out.cast("bigint")


def pronoun_counts(vols: DataFrame) -> DataFrame:
    """(volume_key, feminine, masculine)."""
    c = F.col("text")
    return vols.groupBy("volume_key").agg(F.sum(pronouns(c, R.FEMININE)).alias("feminine"), F.sum(pronouns(c, R.MASCULINE)).alias("masculine"))


def mentions(vols: DataFrame, people: DataFrame) -> DataFrame:
    """(volume_key, key) where a volume names a person."""
    forms = people.select("key", F.explode(F.concat(F.array("key"), "aliases")).alias("form"))
    hits = G.term_hits(vols.select("doc_id", "text"), forms, "doc_id")
    return vols.select("doc_id", "volume_key").join(hits.select("doc_id", "key"), "doc_id").select("volume_key", "key").distinct()


def gender_consistency(vols: DataFrame, people: DataFrame, margin: int = 2) -> DataFrame:
    """(character, volume, expected, feminine, masculine): the first volume sets what is expected."""
    rows = mentions(vols, people).join(pronoun_counts(vols), "volume_key")
    first = Window.partitionBy("key").orderBy("volume_key")
    rows = rows.withColumn("expected", F.when(F.first("feminine").over(first) >= F.first("masculine").over(first), "F").otherwise("M"))
    wrong = ((F.col("expected") == "F") & (F.col("masculine") > F.col("feminine") + margin)) | ((F.col("expected") == "M") & (F.col("feminine") > F.col("masculine") + margin))
    return rows.filter(wrong).select(F.col("key").alias("character"), F.col("volume_key").alias("volume"), "expected", "feminine", "masculine")


def style_counts(vols: DataFrame) -> DataFrame:
    """(volume_key, informal, formal): substring counts, as the rule has them."""
    low = F.lower("text")
    n = lambda words: sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)).cast("bigint")
    return vols.groupBy("volume_key").agg(F.sum(n(R.INFORMAL)).alias("informal"), F.sum(n(R.FORMAL)).alias("formal"))


def voice_consistency(vols: DataFrame, people: DataFrame) -> DataFrame:
    """(character, base, volume): formal in the first volume, informal in this."""
    rows = mentions(vols, people).join(style_counts(vols), "volume_key")
    order = Window.partitionBy("key").orderBy("volume_key")
    rows = rows.withColumns({"base": F.first("volume_key").over(order), "bf": F.first("formal").over(order), "bi": F.first("informal").over(order)})
    return rows.filter("volume_key <> base and bf > bi * 2 and informal > formal * 2").select(F.col("key").alias("character"), "base", F.col("volume_key").alias("volume"))


def timeline_events(vols: DataFrame) -> DataFrame:
    """(tag, volume_key, n) of the events that may contradict."""
    counts = F.array(*[F.struct(F.lit(tag).alias("tag"), F.regexp_count("text", F.lit("(?iu)" + p)).cast("bigint").alias("n")) for tag, p in R.TIMELINE])
    return vols.select("volume_key", F.explode(counts).alias("c")).filter("c.n > 0").groupBy(F.col("c.tag").alias("tag"), "volume_key").agg(F.sum("c.n").alias("n"))


def timeline_conflicts(vols: DataFrame) -> DataFrame:
    """(entity, first_hits, second_hits) of events of which both are told."""
    t = timeline_events(vols).groupBy(F.lit(1).alias("one")).pivot("tag", [tag for tag, _ in R.TIMELINE]).agg(F.sum("n"))
    rows = t.select(F.explode(F.array(F.struct(F.lit("braço direito").alias("entity"), F.col("perdeu_braco").alias("a"), F.col("usou_braco").alias("b")), F.struct(F.lit("personagem").alias("entity"), F.col("morreu").alias("a"), F.col("vivo").alias("b")))).alias("x"))
    return rows.filter("x.a > 0 and x.b > 0").select("x.entity", F.col("x.a").alias("first_hits"), F.col("x.b").alias("second_hits"))


def report(vols: DataFrame, terms: DataFrame, checks: tuple[str, ...] = ("terms", "gender", "voice", "lore")) -> dict:
    """The volumes, the checks made and their findings, as a dict; findings are few and come to the driver."""
    people = registry(terms)
    made = {"terms": lambda: term_inconsistency(terms), "gender": lambda: gender_consistency(vols, people), "voice": lambda: voice_consistency(vols, people), "lore": lambda: timeline_conflicts(vols)}
    issues = [{"check": c, **r.asDict()} for c in checks for r in made[c]().collect()]
    return {"volumes": sorted(r.volume_key for r in vols.select("volume_key").distinct().collect()), "checks": list(checks), "issues": issues}


def all_issues(vols: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, subject, volume, detail): the findings of all checks as one table."""
    people = registry(terms)
    row = lambda kind, subject, volume, detail: [F.lit(kind).alias("kind"), subject.alias("subject"), volume.alias("volume"), detail.alias("detail")]
    c = F.col
    parts = [
        term_inconsistency(terms).select(*row("terms", c("key"), c("volumes"), c("variants"))),
        gender_consistency(vols, people).select(*row("gender", c("character"), c("volume"), c("expected"))),
        voice_consistency(vols, people).select(*row("voice", c("character"), c("volume"), c("base"))),
        timeline_conflicts(vols).select(*row("lore", c("entity"), F.lit(""), F.concat_ws("/", "first_hits", "second_hits"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
