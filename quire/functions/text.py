"""Scalar text functions: columns in, columns out, all of them Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rules as R

def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: All white space, as Unicode has it, and the separators that str.strip drops too.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: What ends a line, as ``lines`` has it.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Runs of white space made one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def lines(c: Column) -> Column:
    """The lines of a text; no last empty line, and none of an empty text."""
    return let(F.split(c, R.LINE_BREAK, -1), lambda p: F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda p: p != "")


def norm_line(c: Column) -> Column:
    """A line as the filters see it: no zero-width characters, single spaces, none at the ends."""
    return F.regexp_replace(strip(F.regexp_replace(F.translate(c, "\xa0", " "), R.ZERO_WIDTH, "")), "[ \t]+", " ")


def norm_repeat(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(norm_line(c)), r"\s+", " "), r"[.,;:!?\-–—]+", "")


def is_ellipsis(c: Column) -> Column:
    return strip(c).rlike(R.ELLIPSIS_LINE)


def starts_speech(c: Column) -> Column:
    return c.rlike(R.QUOTE_OR_DASH_START)


def is_promo(c: Column) -> Column:
    # an address has one of these; most lines have none and are not looked at further
    url = lambda n: n.rlike("[a-z0-9-]\\.[a-z]{2}|www\\.|https?://") & n.rlike("(?i)" + R.URL)
    test = lambda n: (n != "") & (url(n) | any_of([F.contains(n, F.lit(p)) for p in R.PROMO_PHRASES]) | n.rlike("(?i)" + "|".join(f"(?:{p})" for p in R.PROMO_LINES)))
    return let(F.lower(norm_line(c)), test)


def is_section(c: Column) -> Column:
    return strip(c).rlike(R.SECTION)


def is_toc_entry(c: Column) -> Column:
    def test(s: Column) -> Column:
        n = F.lower(s)
        return (s != "") & (
            strip(F.regexp_replace(s, "^#+", "")).rlike(R.SECTION)
            | n.rlike("|".join(R.TOC_MARKERS))
            | n.rlike(r"^(?:prologue|epilogue|afterword|chapter\s+\d+(?::?[^\n]+)?)$")
            | n.rlike(r"^(?:pr[óo]logo|cap[ií]tulo\s+\d+|ep[ií]logo|p[oó]s-?escrito)")
            | ((F.length(s) < 80) & s.rlike(r"\b\d+\b"))
            | ((F.length(s) < 120) & s.rlike(r"\.{2,}\s*\d{1,4}$"))
        )

    return let(norm_line(c), test)


def is_heading(c: Column) -> Column:
    test = lambda n: (n != "") & (strip(F.regexp_replace(n, "^#+", "")).rlike(R.SECTION) | n.rlike(R.SECTION) | n.rlike(r"^(?:prologue|epilogue|afterword|chapter\s+\d+|pr[óo]logo|cap[ií]tulo\s+\d+|ep[ií]logo)"))
    return let(F.lower(norm_line(c)), test)


def chunk_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def count_quotes(c: Column) -> Column:
    return count_of(c, '["“”‟❝❞]')


def nonblank_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def count_paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(strip(c), r"\n\s*\n", -1), lambda p: strip(p) != "")).cast("bigint")


def quote_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: strip(x).rlike('^["“”]'))).cast("bigint")


def contains_any(c: Column, needles) -> Column:
    return any_of([F.contains(c, F.lit(n)) for n in needles])


def has_meta_noise(c: Column) -> Column:
    return contains_any(F.lower(c), R.META_NOISE)


def is_mojibake(c: Column) -> Column:
    return contains_any(c, R.MOJIBAKE)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def alpha_ratio(c: Column) -> Column:
    return count_of(c, r"\p{L}") / F.greatest(F.length(c), F.lit(1))


def volume_key(name: Column) -> Column:
    n = F.regexp_extract(name, r"(?i)vol[ _-]*(\d+)", 1)
    return F.when(n != "", F.format_string("Vol %02d", n.try_cast("int"))).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def format_elapsed(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def classify_chunk(c: Column) -> Column:
    """dialogue, narration or mixed, by the shares of lines and of characters that are speech."""
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    spoken = lambda x: x.rlike('^(?:["“”]|[—–-]\\s)') | x.rlike('["“][^"”]{2,}["”]')

    def kind(rows: Column, speech: Column) -> Column:
        by_line = F.size(speech) / F.greatest(F.size(rows), F.lit(1))
        by_char = chars(speech) / F.greatest(chars(rows), F.lit(1))
        return F.when(F.size(rows) == 0, "narration").when((by_line >= 0.40) | (by_char >= 0.45), "dialogue").when((by_line <= 0.15) & (by_char <= 0.20), "narration").otherwise("mixed")

    return let(nonblank_lines(c), lambda rows: let(F.filter(rows, spoken), lambda speech: kind(rows, speech)))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1)


def detect_language(c: Column, configured: str = "auto") -> Column:
    """A script that decides, else the language of most frequent words, else en."""
    code = language_code(configured)
    if code != "auto":
        return F.lit(code)
    marks = sorted({m for _, words in R.LANGUAGE_MARKERS for m in words.split()})
    # the marks that a text has, by one look at its words; a word is a whole run of letters
    found = lambda sample: F.filter(words_of(sample), lambda w: w.isin(marks))
    count = lambda ws, words: F.size(F.filter(ws, lambda w: w.isin(words.split())))
    scores = lambda ws: F.array(*[F.struct(count(ws, m).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, m) in enumerate(R.LANGUAGE_MARKERS)])
    best = lambda sample: let(F.array_max(let(found(sample), scores)), lambda b: F.when(b["n"] >= R.LANGUAGE_LEAST_HITS, b["lang"]).otherwise(F.lit("en")))

    def decided(sample: Column) -> Column:
        out = best(sample)
        for lang, script in reversed(R.SCRIPT_LANGUAGES):
            out = F.when(sample.rlike(script), lang).otherwise(out)
        scripts = "|".join(script for _, script in R.SCRIPT_LANGUAGES)
        return F.when(sample.rlike(scripts), out).otherwise(best(sample))

    return let(F.substring(c, 1, R.LANGUAGE_SAMPLE), decided)


def language_code(value: str | None) -> str:
    """The code of a language's code, name or alias."""
    wanted = (value or "auto").strip().casefold().replace("_", "-")
    known = {"auto": "auto"} | {a.casefold(): code for code, name, aliases in R.LANGUAGES for a in (code, name, *aliases)}
    if wanted not in known:
        raise ValueError(f"unknown source language {value!r}")
    return known[wanted]


def language_name(code: str) -> str:
    found = language_code(code)
    return {c: n for c, n, _ in R.LANGUAGES}.get(found, "detecção automática")


def term_contains(text: Column, term: Column, case_sensitive: Column | None = None) -> Column:
    """Whether a term stands in a text: as whole words, or anywhere if it has CJK, Kana, Hangul or Thai letters."""
    sensitive = F.lit(False) if case_sensitive is None else case_sensitive
    t = squeeze(term)
    quoted = F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    body = F.regexp_replace(quoted, " ", r"\\s+")
    pattern = F.concat(F.when(sensitive, F.lit("(?U)")).otherwise(F.lit("(?iuU)")), F.lit(r"(?<!\w)(?:"), body, F.lit(r")(?!\w)"))
    cjk = t.rlike("[฀-๿぀-ヿ㐀-鿿가-힯]")
    plain = F.when(sensitive, F.contains(text, t)).otherwise(F.contains(F.lower(text), F.lower(t)))
    return (t != "") & F.when(cjk, plain).otherwise(F.regexp_like(text, pattern))


def strip_accents(c: Column) -> Column:
    return F.translate(c, *R.ACCENTS)


def first_line(c: Column) -> Column:
    """The first line that is not blank, without white space at its ends; an empty string if there is none."""
    return F.coalesce(F.get(nonblank_lines(c), F.lit(0)), F.lit(""))


def last_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(nonblank_lines(c), F.lit(-1)), F.lit(""))


def dash_lines(c: Column) -> Column:
    return F.size(F.filter(nonblank_lines(c), lambda x: F.startswith(x, F.lit("—")))).cast("bigint")


def closed_unopened(c: Column) -> Column:
    """Whether a line closes a speech of eight characters or more that it does not open."""
    return F.exists(nonblank_lines(c), lambda x: F.contains(x, F.lit("”")) & ~F.contains(x, F.lit("“")) & (F.length(strip(F.replace(x, F.lit("”"), F.lit("")))) >= 8))


def occurrences(c: Column, *forms: str) -> Column:
    """How often ``forms`` stand in a text, by plain replacement instead of patterns."""
    return let(c, lambda x: reduce(lambda a, b: a + b, [((F.length(x) - F.length(F.replace(x, F.lit(f), F.lit("")))) / len(f)).cast("int") for f in forms]))


def quote_inflation(before: Column, after: Column) -> Column:
    """Half as many quotes again, and four at least."""
    counts = F.struct(occurrences(before, '"', "“", "”").alias("n"), occurrences(after, '"', "“", "”").alias("m"))
    return let(counts, lambda x: (x["m"] > x["n"]) & (x["m"] >= x["n"] * 1.5) & (x["m"] - x["n"] >= 4))


def odd_breaks(c: Column) -> Column:
    """Whether a text has line breaks other than the usual one."""
    return any_of([F.contains(c, F.lit(x)) for x in BREAKS if x != "\n"])


#: White space within a line.
SPACE = "".join(w for w in WHITE if w not in BREAKS)


def has_line(c: Column, these: Sequence[str]) -> Column:
    """Whether a line of a text is one of ``these`` but for white space at its ends; found without making lines."""
    line, edge = f"[{SPACE}]*+(?:{'|'.join(these)})[{SPACE}]*+", f"[{BREAKS}]"
    return let(c, lambda x: F.when(odd_breaks(x), x.rlike(f"(?:\\A|{edge}){line}(?:\\z|{edge})")).otherwise(x.rlike(f"(?md)^{line}$")))


def is_dash_speech(line: Column) -> Column:
    s = strip(line)
    return F.startswith(s, F.lit("—")) & (F.length(s) > 2)


def attribution(line: Column) -> Column:
    """What follows the dash of a line that says who spoke, or null."""
    said = lambda s: strip(F.when(F.startswith(s, F.lit("—")), F.regexp_extract(s, "^—(.*)$", 1)).otherwise(""))
    return let(let(strip(line), said), lambda body: F.when((body != "") & ~body.rlike(R.PRONOUN_START) & body.rlike(R.ATTRIBUTION), body))


def is_subtitle(line: Column) -> Column:
    """Whether a line may be a chapter's subtitle: some capitalised words without a full stop."""
    n = F.size(F.filter(F.split(squeeze(line), " "), lambda w: w != ""))
    shouted = let(F.regexp_replace(line, "[^\\p{L}]", ""), lambda letters: (letters != "") & (F.upper(letters) == letters))
    return (F.length(line) <= 90) & line.rlike("^\\p{Lu}") & line.rlike(R.SUBTITLE) & ~line.rlike("[.!?]$") & ~shouted & n.between(2, 8)


def time_label(line: Column) -> Column:
    """The name before a label of time, or null."""
    return F.when(line.rlike(R.TIME_LABEL), F.regexp_extract(line, R.TIME_LABEL, 1))


def is_stub(c: Column) -> Column:
    """A chunk that is blank or a section's marker alone."""
    s = strip(c)
    return (s == "") | strip(F.regexp_replace(s, "^#+", "")).rlike(R.SECTION)


def few_words(s: Column, most: int) -> Column:
    """Whether a text without white space at its ends has ``most`` words at most; what is behind them is not looked at."""
    return ~s.rlike(rf"(?U)^(?:[^\s\x1c-\x1f]*+[\s\x1c-\x1f]++){{{most}}}")


def is_short_speech(line: Column) -> Column:
    return let(strip(line), lambda s: (s != "") & (s.rlike('^["“].+["”]$') | (s.rlike('[?!….]["”]?$') & few_words(s, 6))))


def starts_scene(c: Column) -> Column:
    return first_line(c).rlike(R.SCENE)


def ends_scene(c: Column) -> Column:
    return last_line(c).rlike(R.SCENE)


def last_sentence(c: Column) -> Column:
    """The last sentence, without marks of headings and of a model's answer; an empty string if there is none."""
    clean = squeeze(F.regexp_replace(c, "(?i)###\\s*TEXTO_TRADUZ[A-Z_]*", ""))
    parts = F.transform(F.split(F.regexp_replace(clean, "([.!?]) ", "$1\n"), "\n"), lambda x: strip(F.regexp_replace(strip(x), "^#+|#+$", "")))
    return F.coalesce(F.try_element_at(F.filter(parts, lambda x: x != ""), F.lit(-1)), F.lit(""))


def snippet(c: Column, needle: Column, radius: int = 70) -> Column:
    """What stands around a needle's first place, ``radius`` characters on both sides; an empty string without it."""
    at = F.instr(F.lower(c), F.lower(needle))
    begin = F.greatest(at - radius, F.lit(1))
    return F.when((needle == "") | (at == 0), "").otherwise(squeeze(F.substr(c, begin, at + F.length(needle) + radius - begin)))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")


def is_obvious_noise(line: Column) -> Column:
    url = lambda low: contains_any(low, R.AUDIT_URL_PARTS) & low.rlike(R.AUDIT_URL)
    contents = lambda low: contains_any(low, R.AUDIT_CONTENTS_PARTS) & F.regexp_replace(low, "^[ .:-]+|[ .:-]+$", "").rlike(R.AUDIT_CONTENTS)
    test = lambda low: url(low) | contains_any(low, R.AUDIT_NOISE) | contents(low) | strip(low).rlike(r"^\d{1,4}$")
    return let(F.lower(line), test)


def is_suspicious_removal(line: Column, reason: Column) -> Column:
    """Whether a removed line should be looked at again: long, of letters, no obvious noise, a sentence or promotion."""
    tells = reason.isin("promo", "footer") | line.rlike('[.!?”"]$')
    return (F.length(line) >= 35) & (alpha_ratio(line) >= 0.55) & ~is_obvious_noise(line) & tells


def is_valid_term(c: Column) -> Column:
    """Whether a suggestion is a term and no phrase: short, of few words, without articles."""
    phrase = lambda s: let(F.concat(F.lit(" "), F.lower(s), F.lit(" ")), lambda x: contains_any(x, (" que ", " uma ", " um ")))
    return let(strip(c), lambda s: (s != "") & (F.length(s) <= 80) & few_words(s, 6) & ~phrase(s))


def is_short_fragment(c: Column) -> Column:
    words = lambda s: F.filter(F.split(squeeze(F.replace(s, F.lit("—"), F.lit(""))), " "), lambda w: w != "")
    return let(strip(c), lambda s: (s != "") & (F.length(s) <= 25) & (F.size(words(s)) <= 2))


def looks_like_name(c: Column) -> Column:
    """Every word begins with a capital or joins others."""
    letter = "[A-Za-zÀ-ÖØ-öø-ÿ]"
    small = f"(?<!{letter})(?!(?i:{'|'.join(R.NAME_CONNECTORS)})(?!{letter}))(?={letter})[^A-ZÀ-ÖØ-Þ]"  # the first such word decides
    return c.rlike(letter) & ~c.rlike(small)


def residual_type(language: str) -> str:
    return "residual_english" if language_code(language) == "en" else "residual_source_language"


def base_url(c: Column) -> Column:
    """A service's address without its path for generation, or without a slash at its end."""
    return F.when(F.endswith(c, F.lit("/api/generate")), F.regexp_replace(c, "/api/generate$", "")).otherwise(F.regexp_replace(c, "/+$", ""))


def quality_cell(score: Column, types: Column) -> Column:
    """``score``/100 and the first three of ``types``, an array of issue types, by name with their counts."""
    names = F.slice(F.array_sort(F.array_distinct(types)), 1, 3)
    cells = F.transform(names, lambda n: F.concat(n, F.lit(":"), F.size(F.filter(types, lambda x: x == n)).cast("string")))
    return F.concat(score.cast("string"), F.lit("/100"), F.when(F.size(names) > 0, F.concat(F.lit(" ("), F.array_join(cells, ", "), F.lit(")"))).otherwise(F.lit("")))


def story_kind(line: Column) -> Column:
    """What a line of Markdown is: blank, heading2, heading1, dialogue or body."""
    s = strip(line)
    return F.when(s == "", "blank").when(F.startswith(s, F.lit("## ")), "heading2").when(F.startswith(s, F.lit("# ")), "heading1").when(s.rlike("^[—–-] "), "dialogue").otherwise("body")


def inline_html(c: Column) -> Column:
    """Escaped text with Markdown's bold and italic as tags."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    for pattern, tag in ((r"\*\*(.+?)\*\*", "b"), (r"__(.+?)__", "b"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "i"), (r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", "i")):
        c = F.regexp_replace(c, pattern, f"<{tag}>$1</{tag}>")
    return c


def markdown_blocks(c: Column) -> Column:
    """The paragraphs of a text, with <br> as line ends."""
    c = F.regexp_replace(F.regexp_replace(c, "<br/?>", "\n"), "\r\n?", "\n")
    return F.filter(F.transform(F.split(c, "\n\\s*\n", -1), strip), lambda x: x != "")


def joined_sentences(c: Column) -> Column:
    """Lines joined until one ends a sentence or a blank line comes; a blank line between the parts."""
    marked = F.transform(lines(c), lambda x: let(strip(x), lambda s: F.when(s == "", "\x1e").when(s.rlike("[.!?…]$"), F.concat(s, F.lit("\x1e"))).otherwise(F.concat(s, F.lit(" ")))))
    return F.array_join(F.filter(F.transform(F.split(F.array_join(marked, ""), "\x1e", -1), strip), lambda x: x != ""), "\n\n")


def spaced_capitals(c: Column) -> Column:
    """The lines with capitals that are spelled apart."""
    return F.filter(F.transform(lines(c), strip), lambda x: x.rlike(R.SPACED_CAPITALS))


def heading_in_portuguese(title: Column) -> Column:
    """A known section's title as a Portuguese heading, or null."""
    t = strip(F.regexp_replace(strip(title), "^#+|#+$", ""))
    number = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in R.CHAPTERS])
    rest = strip(F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 2)) for p in R.CHAPTERS]))
    suffix = F.when(rest != "", F.concat(F.lit(": "), rest)).when(t.rlike("[:：]\\s*$"), ":").otherwise("")
    out = F.when(number.isNotNull(), F.concat(F.lit("# Capítulo "), number, suffix))
    for pattern, heading in reversed(R.HEADINGS):
        out = F.when(t.rlike(pattern), heading).otherwise(out)
    return F.when((t != "") & (F.lower(t) != "full text"), out)


def with_heading(c: Column, title: Column) -> Column:
    """A section's text with its heading, which is set before it unless its first line is one."""
    heading = heading_in_portuguese(title)
    put = F.when(strip(c) == "", heading).otherwise(F.concat(heading, F.lit("\n\n"), strip(c)))
    return F.when(heading.isNull() | first_line(c).rlike(R.PT_HEADING), c).otherwise(put)


def dialogue_blocks(c: Column) -> Column:
    """Each line of speech alone, and the lines of narration between blank lines and speech together."""
    speech = "^[\"“”’\\-—]"
    flat = F.transform(lines(c), lambda x: let(strip(x), lambda s: F.when(s == "", "\x1e").when(s.rlike(speech), F.concat(F.lit("\x1e"), s, F.lit("\x1e"))).otherwise(F.concat(s, F.lit("\n")))))
    return F.filter(F.transform(F.split(F.array_join(flat, ""), "\x1e", -1), strip), lambda x: x != "")
