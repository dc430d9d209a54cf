"""Line and paragraph operators within one row: a text's lines are an array, and array functions look at them.

Nothing is shuffled and no row is lost: a null or empty text has no lines and becomes an empty text, and rows that
repeat a doc_id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.functions.text import let



def lines_of(c: Column) -> Column:
    return T.lines(F.coalesce(c, F.lit("")))


def paragraphs_of(c: Column) -> Column:
    return T.paragraphs(F.coalesce(c, F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), line_no from 0."""
    return docs.select("doc_id", F.posexplode(lines_of(docs["text"])).alias("line_no", "line"))


def per_row(f: Callable[..., Column]) -> Callable[..., DataFrame]:
    """An operator of documents, (doc_id, text, kept, removed), by a column function of texts, which is its ``column``."""

    @wraps(f)
    def on(docs: DataFrame, *args, **named) -> DataFrame:
        return docs.select("doc_id", f(docs["text"], *args, **named).alias("s")).select("doc_id", "s.text", "s.kept", "s.removed")

    on.column = f
    return on


def marked(items: Column, mark: Callable[[Column], Column]) -> Column:
    """Structs (x, m, before, after) of the items, their marks and those of their neighbours; items and marks are made once."""
    pair = lambda items, marks: F.transform(items, lambda x, i: F.struct(x.alias("x"), F.get(marks, i).alias("m"), F.when(i > 0, F.get(marks, i - 1)).alias("before"), F.get(marks, i + 1).alias("after")))
    return let(items, lambda once: let(F.transform(once, mark), lambda marks: pair(once, marks)))


def kept(structs: Column, keep: Callable[[Column], Column], separator: str = "\n") -> Column:
    """struct(text, kept, removed): the text of the items (x, ...) that are kept, and how many are and are not."""
    chosen = lambda s: F.transform(F.filter(s, lambda x: F.coalesce(keep(x), F.lit(True))), lambda x: x["x"])
    out = lambda s: let(chosen(s), lambda k: F.struct(F.array_join(k, separator).alias("text"), F.size(k).cast("bigint").alias("kept"), (F.size(s) - F.size(k)).cast("bigint").alias("removed")))
    return let(structs, out)


def without(items: Column, drop: Callable[[Column], Column], separator: str = "\n") -> Column:
    """The items for which ``drop`` does not hold, as ``kept`` gives them."""
    return kept(F.transform(items, lambda x: F.struct(x.alias("x"))), lambda s: ~drop(s["x"]), separator)


@per_row
def dedupe_consecutive(c: Column) -> Column:
    """Drops a line equal to the one before it; speech, ellipses and blank lines start anew."""
    norm = lambda x: F.when(T.is_ellipsis(x) | T.starts_speech(x), F.lit("")).otherwise(T.norm_line(x))
    return kept(marked(lines_of(c), norm), lambda s: ~((s["m"] != "") & s["m"].eqNullSafe(s["before"])))


@per_row
def collapse_lines(c: Column) -> Column:
    """Drops a line that says what the line before it says."""
    return kept(marked(lines_of(c), T.strip), lambda s: ~((s["m"] != "") & s["m"].eqNullSafe(s["before"])))


@per_row
def collapse_paragraphs(c: Column) -> Column:
    items = paragraphs_of(c)
    return kept(marked(items, lambda x: x), lambda s: ~s["m"].eqNullSafe(s["before"]), "\n\n")


@per_row
def dedupe_prefix(c: Column) -> Column:
    """Drops a line cut short that the next line has whole."""

    def whole(s: Column) -> Column:
        here, after = s["m"], s["after"]
        blocked = F.startswith(after["s"], F.lit("“")) | here["s"].rlike(r"^\d+$")
        open_end = ~here["n"].rlike(r"[.!?:;]['\")\]]?\s*$")
        return ~(~blocked & (here["n"] != "") & (F.length(after["n"]) > F.length(here["n"])) & F.startswith(after["n"], here["n"]) & open_end)

    items = lines_of(c)
    return kept(marked(items, lambda x: F.struct(T.strip(x).alias("s"), T.squeeze(x).alias("n"))), whole)


def repeat_norm(line: Column) -> Column:
    """A line as repetitions are counted; empty where it is never counted."""
    return F.when(T.is_ellipsis(line) | T.starts_speech(line), F.lit("")).otherwise(T.norm_repeat(line))


def line_runs(items: Column, norm: Callable[[Column], Column]) -> Column:
    """One struct (norm, first, n, at) for each distinct norm: its first line, how often it is there, and its lines."""
    ordered = F.sort_array(F.transform(items, lambda x, i: F.struct(norm(x).alias("norm"), i.alias("i"))))

    def group(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["norm"] != F.get(s, i - 1)["norm"]), i)), lambda i: i.isNotNull())
        ends = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s))
        run = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["norm"].alias("norm"), F.get(s, i)["i"].alias("first"), (ends(b, k) - i).alias("n"), F.transform(F.slice(s, i + 1, ends(b, k) - i), lambda x: x["i"]).alias("at")))
        return let(begins, run)

    return let(ordered, group)


@per_row
def remove_repeated(c: Column, least: int = R.REPEAT_FREQUENCY, most: int = R.REPEAT_LENGTH) -> Column:
    """Drops short lines that a document has again and again, as headers are."""
    drop = lambda r: (r["norm"] != "") & (r["n"] >= least) & ((F.length(r["norm"]) <= most) | T.is_promo(r["norm"]))
    flags = lambda items: F.flatten(F.transform(line_runs(items, repeat_norm), lambda r: let(drop(r), lambda d: F.transform(r["at"], lambda i: F.struct(i.alias("i"), d.alias("d"))))))
    structs = lambda items: let(F.sort_array(flags(items)), lambda f: F.transform(items, lambda x, i: F.struct(x.alias("x"), F.get(f, i)["d"].alias("d"))))
    return kept(let(lines_of(c), structs), lambda s: ~s["d"] | T.strip(s["x"]).rlike(r"^\*{2,}$"))


def top_repeated(docs: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, norm, freq) of a document's commonest lines; ties by first appearance."""
    runs = F.filter(line_runs(lines_of(docs["text"]), repeat_norm), lambda r: r["norm"] != "")
    best = F.slice(F.array_sort(F.transform(runs, lambda r: F.struct((-r["n"]).alias("less"), r["first"].alias("first"), r["norm"].alias("norm")))), 1, k)
    rows = docs.select("doc_id", F.posexplode(best).alias("i", "r"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("r.norm").alias("norm"), (-F.col("r.less")).cast("bigint").alias("freq"))


@per_row
def remove_numeric(c: Column) -> Column:
    """Drops lines of digits alone."""
    return without(lines_of(c), lambda x: T.strip(x).rlike(r"^\d+$"))


@per_row
def remove_blank(c: Column) -> Column:
    return without(lines_of(c), lambda x: T.strip(x) == "")


@per_row
def remove_meta(c: Column, patterns=R.META_TRANSLATE) -> Column:
    """Drops lines in which a model speaks of itself."""
    return without(lines_of(c), lambda x: let(F.lower(x), lambda low: T.any_of([low.rlike(p) for p in patterns])))


@per_row
def remove_promo(c: Column) -> Column:
    """Drops promotional lines, but for speech; ``prose.promo`` also takes what follows them."""
    return without(lines_of(c), lambda x: T.is_promo(x) & ~T.starts_speech(x))


@per_row
def remove_noise(c: Column) -> Column:
    """Drops the paragraphs that a noise pattern hits."""
    return without(paragraphs_of(c), lambda x: let(F.lower(x), lambda low: T.any_of([low.rlike("(?is)" + p) for p in R.NOISE_PARAGRAPHS])), "\n\n")


@per_row
def remove_lone_quotes(c: Column) -> Column:
    """Drops lines that are quotes alone."""
    return without(lines_of(c), lambda x: T.strip(x).isin('"', "“", "”", "'''", '"""'))


@per_row
def remove_headers(c: Column) -> Column:
    """Drops page numbers, short capitals and lines that name a page."""
    drop = lambda s: s.rlike(r"^\d{1,4}$") | ((F.length(s) <= 5) & (F.upper(s) == s) & (F.lower(s) != s)) | s.rlike(r"(?i)\bpage\b")
    return without(F.transform(lines_of(c), T.strip), drop)


def noise_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, pattern_no) of the paragraphs that a noise pattern hits; the first pattern counts."""
    case = F.lit(None).cast("int")
    for i in reversed(range(len(R.NOISE_PARAGRAPHS))):
        case = F.when(F.col("line").rlike("(?is)" + R.NOISE_PARAGRAPHS[i]), i).otherwise(case)
    rows = docs.select("doc_id", F.posexplode(paragraphs_of(docs["text"])).alias("paragraph_no", "line"))
    return rows.select("doc_id", "paragraph_no", case.alias("pattern_no")).filter("pattern_no is not null")


def line_flags(docs: DataFrame) -> DataFrame:
    """How many lines of a document are promotion, contents, headings, long."""
    n = lambda test: F.size(F.filter(F.col("l"), test)).cast("bigint")
    return docs.select("doc_id", lines_of(docs["text"]).alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), n(T.is_promo).alias("promo"), n(T.is_toc_entry).alias("toc"), n(T.is_heading).alias("headings"),
        F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).cast("bigint").alias("max_length"), n(lambda x: F.length(x) > 800).alias("over_800"),
    )


def front_matter_start(docs: DataFrame) -> DataFrame:
    """(doc_id, start): the first section marker's line, null if there is none."""
    bare = lambda x: T.strip(F.regexp_replace(T.strip(x), "^#+", ""))
    places = F.transform(lines_of(docs["text"]), lambda x, i: F.when(bare(x).rlike(R.SECTION), i))
    return docs.select("doc_id", F.array_min(places).cast("bigint").alias("start"))


@per_row
def strip_front_matter(c: Column) -> Column:
    """The text from its first section marker on; a text without one stays."""
    bare = lambda x: T.strip(F.regexp_replace(T.strip(x), "^#+", ""))
    items = lines_of(c)
    start = F.array_min(F.transform(items, lambda x, i: F.when(bare(x).rlike(R.SECTION), i)))
    structs = let(start, lambda at: F.transform(items, lambda x, i: F.struct(F.when(i == at, F.ltrim(x)).otherwise(x).alias("x"), (at.isNull() | (i >= at)).alias("k"))))
    return kept(structs, lambda s: s["k"])


def _parts(items: Column, is_start: Callable[[Column], Column]) -> Column:
    """The lines in parts (head, body, start_idx, end_idx), with places of characters; a part begins at each start.

    ``items`` is a column of its own, for it is looked at again and again.
    """
    begins = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | is_start(x), i)), lambda i: i.isNotNull())
    own = lambda i, e: F.slice(items, i + 1, e - i)
    one = lambda i, e: let(own(i, e), lambda x: let(F.when(is_start(F.get(x, F.lit(0))), T.strip(F.get(x, F.lit(0)))), lambda h: F.struct(h.alias("head"), T.strip(F.array_join(F.when(h.isNull(), x).otherwise(F.slice(x, 2, F.size(x))), "\n")).alias("body"), (F.length(F.array_join(x, "\n")) + 1).cast("bigint").alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<head:string,body:string,start_idx:bigint,end_idx:bigint>>").alias("out"))
    add = lambda s, p: F.struct((s["at"] + p["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(p["head"].alias("head"), p["body"].alias("body"), s["at"].alias("start_idx"), (s["at"] + p["n"]).alias("end_idx")))).alias("out"))
    parts = let(begins, lambda b: F.transform(b, lambda i, k: one(i, F.coalesce(F.get(b, k + 1), F.size(items)))))
    return F.aggregate(parts, start, add, lambda s: s["out"])


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_idx, title, body, start_idx, end_idx) by section markers; stub bodies are no sections."""
    rows = docs.select("doc_id", lines_of(docs["text"]).alias("l"))
    rows = rows.select("doc_id", _parts(F.col("l"), lambda x: T.strip(x).rlike(R.SECTION)).alias("p"))
    stub = lambda p: (p["body"] == "") | ((F.length(p["body"]) <= 10) & p["body"].rlike(r"^[\d\s.]+$"))
    marked_any = F.exists("p", lambda p: p["head"].isNotNull())
    kept = F.filter("p", lambda p: F.when(p["head"].isNull(), ~F.col("m") | (p["body"] != "")).otherwise(~stub(p)))
    out = rows.withColumn("m", marked_any).select("doc_id", "m", F.posexplode(kept).alias("i", "p"))
    plain = F.col("p.head").isNull()
    return out.select(
        "doc_id",
        F.col("i").cast("bigint").alias("section_idx"),
        F.when(plain, "Full Text").otherwise(F.col("p.head")).alias("title"),
        F.when(plain, F.col("p.body")).otherwise(F.concat(F.lit("# "), "p.head", F.lit("\n\n"), "p.body")).alias("body"),
        "p.start_idx",
        F.when(plain & ~F.col("m"), F.col("p.end_idx") - 1).otherwise(F.col("p.end_idx")).alias("end_idx"),
    )


def section_map(docs: DataFrame) -> DataFrame:
    """(doc_id, title, start_idx, end_idx, chars): the sections without their bodies."""
    return sections(docs).select("doc_id", "title", "start_idx", "end_idx", F.length("body").cast("bigint").alias("chars"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, body) by # headings; what stands before the first is section 0."""
    rows = docs.select("doc_id", lines_of(docs["text"]).alias("l")).select("doc_id", _parts(F.col("l"), lambda x: x.rlike(r"^#{1,6}\s+\S")).alias("p"))
    rows = rows.select("doc_id", F.posexplode("p").alias("i", "p"), F.get("p", F.lit(0))["head"].isNotNull().alias("headed"))
    no = F.col("i") + F.when(F.col("headed"), 1).otherwise(0)
    return rows.filter(F.col("p.head").isNotNull() | (F.col("p.body") != "")).select("doc_id", no.cast("bigint").alias("section_no"), F.coalesce("p.head", F.lit("")).alias("heading"), F.col("p.body").alias("body"))
