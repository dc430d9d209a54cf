"""Text rewriting as ordered rules: every function takes a column and gives a column, all in Catalyst.

A rule is (pattern, replacement) in Java's dialect; ``rewrite`` applies rules in order and ``hits`` counts what
each of them would replace at its turn.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T

Rules = Sequence[tuple[str, str]]
#: What stands alone in a line and is no text; a model's answer may have the last as well.
LONELY = ('"', "“", "”", '"""')
LONELY_ANSWER = (*LONELY, "'''")


def rewrite(c: Column, rules: Rules) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def hits(c: Column, rules: Rules) -> Column:
    n = F.lit(0).cast("bigint")
    for pattern, by in rules:
        n = n + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, by)
    return n


def each_line(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(T.lines(c), f), "\n")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def drop_invisible(c: Column) -> Column:
    """Without soft hyphens and zero-width characters; hard spaces made plain."""
    return F.translate(F.regexp_replace(c, R.ZERO_WIDTH[:-1] + "\\x{00ad}]", ""), "\xa0", " ")


def drop_footers(c: Column) -> Column:
    return rewrite(c, [("(?i)" + p, " ") for p in R.FOOTERS])


def fix_hyphen_breaks(c: Column) -> Column:
    return F.regexp_replace(c, R.HYPHEN_BREAK, "$1-$2")


def fix_ellipsis(c: Column) -> Column:
    return rewrite(c, R.ELLIPSIS_SPACING)


def strip_inline_marks(c: Column) -> Column:
    return rewrite(c, R.INLINE_MARKS)


def collapse_curly(c: Column) -> Column:
    return F.regexp_replace(c, "([“”])\\1+", "$1")


def dialogue_breaks(c: Column) -> Column:
    return rewrite(c, R.DIALOGUE_BREAKS)


def strip_triple_quotes(c: Column) -> Column:
    return F.regexp_replace(c, '(?m)"""+[ \\t]*$', "")


def drop_thinking(c: Column) -> Column:
    return F.regexp_replace(c, R.THINKING, "")


def sanitize_output(c: Column) -> Column:
    """A model's answer without its phrases, fences and thinking marks."""
    for p in R.MODEL_PHRASES:
        c = F.replace(c, F.lit(p), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, "(?s)```.+?```", ""), "\\s{3,}", " ")
    return T.strip(F.replace(F.replace(c, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit("")))


def drop_marker_lines(c: Column) -> Column:
    return F.array_join(F.filter(T.lines(c), lambda x: ~x.rlike(R.MARKERS)), "\n")


def between_markers(c: Column) -> Column:
    """What stands between a translation's marks, or before its end mark, or all; null if that is blank."""
    inside = lambda x: F.regexp_extract(x, "(?is)###\\s*TEXTO_TRADUZIDO_INICIO\\s*(.*?)\\s*###\\s*TEXTO_TRADUZIDO_FIM", 1)
    before = lambda x: F.regexp_extract(x, "(?is)^(.*?)\\s*###\\s*TEXTO_TRADUZIDO_FIM", 1)
    found = lambda first, other: T.let(first, lambda f: F.when(f != "", f).otherwise(other))
    out = T.strip(T.let(c, lambda x: F.when(F.contains(x, F.lit("###")), found(inside(x), found(before(x), x))).otherwise(x)))
    return T.let(out, lambda o: F.when(o != "", o))


def line_dashes(c: Column) -> Column:
    """A hyphen or a short dash that begins a line of speech made a long one."""
    return each_line(c, lambda x: F.regexp_replace(x, "^(\\s*)[-–] ", "$1— "))


def pair_straight_quotes(c: Column) -> Column:
    """Straight quotes, if they are even and not at digits, made opening and closing ones in turn."""
    mark = "(?<!\\d)\"(?!\\d)"

    def turned(x: Column) -> Column:
        return T.let(F.split(x, mark, -1), lambda parts: T.let(F.size(parts) - 1, lambda n: F.when((n > 0) & (n % 2 == 0), F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i == n, "").when(i % 2 == 0, "“").otherwise("”"))), "")).otherwise(x)))

    return T.let(c, turned)


def normalize_dialogue_quotes(c: Column) -> Column:
    """Straight quotes made curly in pairs, and quotes spaced."""
    return rewrite(pair_straight_quotes(c), R.QUOTE_SPACING)


def separate_narration(c: Column) -> Column:
    """A blank line between lines of narration that follow each other; blank lines made one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("text"), F.lit(False).alias("speech"))

    def step(s: Column, line: Column) -> Column:
        x = T.strip(line)
        blank, speech = x == "", F.startswith(x, F.lit("— "))
        gap = F.when(blank, (F.size(s.out) > 0) & (F.try_element_at(s.out, F.lit(-1)) != "")).otherwise(s.text & ~speech & ~s.speech)
        add = F.concat(F.when(gap, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.when(blank, F.array().cast("array<string>")).otherwise(F.array(x)))
        return F.struct(F.concat(s.out, add).alias("out"), (~blank).alias("text"), (~blank & speech).alias("speech"))

    return T.strip(F.array_join(F.aggregate(T.lines(c), start, step, lambda s: s.out), "\n"))


def final_postprocess(c: Column) -> Column:
    """Punctuation, quotes, dashes, marks and paragraphs of a finished text, in their order."""
    c = F.replace(F.regexp_replace(c, "\\.{3,}", "…"), F.lit("--"), F.lit("—"))
    c = F.regexp_replace(c, "(?m)^([ \\t]*)\\*{2}(?=[ \\t]+\\S)", "$1***")
    c = rewrite(rewrite(rewrite(pair_straight_quotes(c), R.QUOTE_SPACING), R.PUNCTUATION), R.QUOTE_SPACING)
    c = F.regexp_replace(F.regexp_replace(line_dashes(c), R.MARKERS, ""), "\n{3,}", "\n\n")
    return separate_narration(c)


def sentence_case_caps(c: Column) -> Column:
    """Lines all in capitals made sentences; headings, cries and speech stay."""

    def fix(line: Column) -> Column:
        s = T.strip(line)
        caps = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) > 8) & F.contains(s, F.lit(" "))
        plain = ~T.is_heading(s) & ~s.rlike("^\\*{2,}$") & ~s.rlike("[!?]") & ~s.rlike("^[\"“‘]")
        head, body = F.regexp_extract(s, "^([\"“‘(\\[]*)", 1), F.lower(F.regexp_replace(s, "^[\"“‘(\\[]*", ""))
        return F.when(caps & plain, F.concat(head, F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)))).otherwise(line)

    return each_line(c, fix)


def leading_small_caps(c: Column) -> Column:
    """AFTER MARA watched, at the start of a line, made After Mara watched."""
    pattern = "^([\"“‘(\\[]?)(AFTER|BEFORE|WHEN|WHILE|ONCE)\\s+([A-Z]{3,})(\\s+.*[a-zà-öø-ÿ].*)$"

    def fix(line: Column) -> Column:
        s = T.strip(line)
        g = lambda i: F.regexp_extract(s, pattern, i)
        ok = s.rlike(pattern) & ~g(3).isin("THE", "AND", "FOR", "WITH") & ~T.is_heading(s)
        return F.when(ok, F.concat(g(1), F.initcap(F.lower(g(2))), F.lit(" "), F.initcap(F.lower(g(3))), g(4))).otherwise(line)

    return each_line(c, fix)


def unwrap_triple_quotes(c: Column) -> Column:
    return T.let(T.strip(c), lambda s: F.when(s.rlike('(?s)^""".*"""$') & (F.length(s) >= 6), T.strip(F.substr(s, F.lit(4), F.length(s) - 6))).otherwise(s))


def unbreak(c: Column) -> Column:
    """The lines of a paragraph in one line; headings stand alone; a hyphen before a small letter goes."""

    def paragraph(p: Column) -> Column:
        start = F.array().cast("array<string>")

        def step(out: Column, line: Column) -> Column:
            x = T.strip(line)
            last = F.try_element_at(out, F.lit(-1))
            apart = (F.size(out) == 0) | x.startswith("#") | last.startswith("#")
            joined = F.when(F.endswith(last, F.lit("-")) & x.rlike("^\\p{Ll}"), F.concat(F.regexp_replace(last, "-$", ""), x)).otherwise(F.concat_ws(" ", last, x))
            return F.when(x == "", out).when(apart, F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined)))

        return F.array_join(F.aggregate(F.split(p, "\n", -1), start, step), "\n\n")

    return T.strip(F.array_join(F.transform(F.split(normalize_newlines(c), "\n\n", -1), paragraph), "\n\n"))


EDITORS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "editor-lite": (lambda x: rewrite(x, R.EDITOR_LITE), "spacing or repetition by accident"),
    "editor-voice": (lambda x: F.when(F.ltrim(x).startswith("—"), rewrite(x, R.EDITOR_VOICE)).otherwise(x), "rhythm and spacing of speech"),
    "editor-strict": (lambda x: rewrite(x, R.EDITOR_STRICT), "fewer fillers"),
}


CONSISTENCY = "names and forms as the editors' memory has them"


def consistent(x: Column, memory: dict) -> Column:
    """A line with what an editors' memory replaces: its ``replacements``, whatever their case, and the forms it prefers."""
    given = memory.get("replacements")
    for old, new in (given if isinstance(given, dict) else {}).items():
        if isinstance(old, str) and isinstance(new, str) and old:
            x = F.regexp_replace(x, "(?iu)\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E", new.replace("\\", "\\\\").replace("$", "\\$"))
    return rewrite(x, [(pattern, by) for name, pattern, by in R.EDITOR_PREFERENCES if memory.get(name)])


def edit(c: Column, modes: Sequence[str] = tuple(EDITORS), replacements: dict[str, str] | None = None, memory: dict | None = None) -> Column:
    """The editors' passes over each line; what their memory tells comes after the first."""
    memory = {**(memory or {}), **({"replacements": replacements} if replacements else {})}

    def line(x: Column) -> Column:
        for mode in modes:
            x = EDITORS[mode][0](x)
            if mode == "editor-lite":
                x = consistent(x, memory)
        return x

    return each_line(c, line)


def changes(docs: DataFrame, mode: str, memory: dict | None = None) -> DataFrame:
    """(doc_id, line, before, after, reason, mode) of the lines that an editor changes; lines from 1."""
    f, reason = EDITORS[mode] if mode in EDITORS else (lambda x: consistent(x, memory or {}), CONSISTENCY)
    rows = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "before")).withColumn("after", f(F.col("before")))
    return rows.filter("before <> after").select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"), "before", "after", F.lit(reason).alias("reason"), F.lit(mode).alias("mode"))


def reflow_problems(original: Column, output: Column) -> Column:
    """Why a reflowed text is not accepted."""
    dots = lambda c: T.occurrences(c, "...", "…")
    letters = lambda c: T.let(c, lambda x: F.length(x) - F.length(F.regexp_replace(x, "[\\p{L}\\p{N}]+", "")))
    lost = T.let(F.struct(letters(original).alias("n"), letters(output).alias("m")), lambda x: (x["n"] > 0) & (x["m"] < x["n"] * 0.99))
    found = F.array(F.when(T.has_line(output, LONELY), F.lit("lonely_quote_line")), F.when(dots(output) != dots(original), F.lit("ellipsis_mismatch")), F.when(lost, F.lit("alnum_loss")))
    return F.filter(found, lambda x: x.isNotNull())


def squeeze_punctuation(c: Column) -> Column:
    """Runs of spaces made one, none before punctuation, blank lines one."""
    return T.strip(rewrite(c, (("[ \\t]+", " "), (" +([,.;:!?])", "$1"), ("\n{3,}", "\n\n"))))


def join_spaced_pairs(c: Column) -> Column:
    """W E made WE, in each line."""
    return each_line(c, lambda x: F.regexp_replace(x, "\\b([A-Z])\\s+([A-Z])\\b", "$1$2"))


def mend_mixed_capitals(c: Column) -> Column:
    """Words with more capitals than small letters made small, at a line's beginning with a capital; spaces made one."""

    def word(w: Column, i: Column) -> Column:
        up, low = F.regexp_count(w, F.lit("[A-Z]")), F.regexp_count(w, F.lit("[a-z]"))
        odd = (up >= 2) & (low >= 1) & (up > low) & ~w.rlike("[-–—'’…]|\\.\\.\\.")
        small = F.lower(w)
        return F.when(~odd, w).when(i == 0, F.concat(F.upper(F.substring(small, 1, 1)), F.substr(small, F.lit(2)))).otherwise(small)

    return each_line(c, lambda x: F.array_join(F.transform(F.split(T.squeeze(x), " "), word), " "))


def isolate_subtitle(c: Column) -> Column:
    """Under a chapter's line, a subtitle parted from the capitals that it runs into."""
    word = "(?:[A-Z][A-Za-z'’-]*|the|of|and|a|an|to|in|on|at|for|with|after|before)"
    pattern = f"(?m)^([ \\t]*(?i:chapter)\\s+\\d+:?[ \\t]*\\n(?:[ \\t]*\\n)*)[ \\t]*({word}(?:[ \\t]+{word}){{0,7}}?)[ \\t]+([A-Z]{{2,}}\\b.*)$"
    return F.regexp_replace(c, pattern, "$1$2\n\n$3")


def close_dialogue(c: Column) -> Column:
    """No blank line between two lines that begin with a double quote."""
    return F.regexp_replace(c, '(?m)^([ \\t]*["“][^\\n]*)\\n[ \\t]*\\n(?=[ \\t]*["“])', "$1\n")


def dehyphenate(c: Column) -> Column:
    """A word broken by a hyphen joined before the line's end."""
    return F.regexp_replace(c, "(?U)(\\w+)-\\s*\\n(\\w+)", "$1$2\n")


def clean_text(c: Column) -> Column:
    """Optional cleaning: spaces, ornaments and hyphens; unfinished lines joined."""
    c = rewrite(normalize_newlines(c), (("[ \\t]{2,}", " "), ("[ \\t]+\\n", "\n"), ("\n{3,}", "\n\n"), ("[■◆◇♢]+", ""), ("(?:<lf>|<LF>)", "")))
    c = dehyphenate(c)
    flat = F.transform(T.lines(c), lambda x: T.let(T.strip(x), lambda s: F.when(s == "", "\x1e\x1e").when(F.startswith(s, F.lit("—")), F.concat(F.lit("\x1e"), s, F.when(s.rlike("[.!?—]$"), "\x1e").otherwise(" "))).when(s.rlike("[.!?—]$"), F.concat(s, F.lit("\x1e"))).otherwise(F.concat(s, F.lit(" ")))))
    return T.strip(F.regexp_replace(F.regexp_replace(F.array_join(flat, ""), " *\x1e", "\x1e"), "\x1e+", "\n"))


def safe_dialogue_breaks(c: Column) -> Column:
    return rewrite(c, R.SAFE_DIALOGUE_BREAKS)


def structural(c: Column) -> Column:
    """Glued speeches parted, then stray triple quotes dropped."""
    return strip_triple_quotes(dialogue_breaks(c))


def isolate_stars(c: Column) -> Column:
    """*** between blank lines; blank lines are one.  Lines are made only of texts with odd breaks or a break at their end."""
    by_lines = lambda x: F.array_join(F.transform(T.lines(x), lambda y: F.when(T.strip(y) == "***", "\n***\n").otherwise(y)), "\n")
    apart = lambda x: F.when(T.odd_breaks(x) | F.endswith(x, F.lit("\n")), by_lines(x)).when(F.contains(x, F.lit("***")), F.regexp_replace(x, f"(?md)^[{T.SPACE}]*+\\*\\*\\*[{T.SPACE}]*+$", "\n***\n")).otherwise(x)
    return T.let(T.let(c, apart), lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x))


def unbreak_output(c: Column) -> Column:
    """A model's unbroken text without wrappers, lone quotes, hyphens at line ends and spaces in stutters.

    Lines are made and patterns are sought only where a text has what they are for.
    """
    without = lambda x: F.array_join(F.filter(T.lines(x), lambda y: ~T.strip(y).isin(*LONELY_ANSWER)), "\n")
    c = T.let(unwrap_triple_quotes(c), lambda x: F.when(T.odd_breaks(x) | T.has_line(x, LONELY_ANSWER), without(x)).otherwise(x))
    where = lambda c, needed, pattern: T.let(c, lambda x: F.when(x.rlike(needed), F.regexp_replace(x, pattern, "$1-$2")).otherwise(x))
    c = where(c, "-[\\s\\x85\\p{Z}]*\\n", "(?U)(\\w)-\\s*\\n\\s*(\\w)")
    c = where(c, "-(?<=[A-Za-zÀ-ÿ]-)\\s", "\\b([A-Za-zÀ-ÿ])-\\s+([A-Za-zÀ-ÿ])")
    return isolate_stars(c)


def postprocess_translation(c: Column, source: Column | None = None) -> Column:
    """English left over, parry where the source has it and no birth is told of, and quotes of speeches with a dash."""
    c = rewrite(collapse_curly(c), R.LEFT_ENGLISH)
    if source is not None:
        c = T.let(c, lambda x: F.when(source.rlike(R.PARRY_SOURCE) & ~x.rlike(R.BIRTH), rewrite(x, R.PARRY)).otherwise(x))
    clean = lambda x: T.let(rewrite(T.strip(x), R.DASH_AND_QUOTE), lambda s: F.when(s != "", s).otherwise(x))
    return each_line(c, clean)


def separate_short_speeches(c: Column) -> Column:
    """A blank line between short lines of speech that follow each other."""
    flags = lambda ls: F.transform(ls, T.is_short_speech)
    put = lambda ls: T.let(flags(ls), lambda f: F.transform(ls, lambda x, i: F.when((i > 0) & F.get(f, i) & F.get(f, i - 1), F.concat(F.lit("\n"), x)).otherwise(x)))
    return F.array_join(T.let(T.lines(c), put), "\n")


def repaired_text(c: Column) -> Column:
    """What stands between a repair's marks, or null."""
    return F.nullif(T.strip(F.regexp_extract(c, R.REPAIRED_BLOCK, 1)), F.lit(""))


def split_suggestions(c: Column) -> Column:
    """struct(refined, block): a refinement and the block of suggestions behind it, null without one."""
    begin, end = F.instr(c, F.lit(R.SUGGESTED[0])), F.instr(c, F.lit(R.SUGGESTED[1]))
    both = (begin > 0) & (end > begin)
    block = T.strip(F.substr(c, begin + len(R.SUGGESTED[0]), end - begin - len(R.SUGGESTED[0])))
    return F.struct(T.strip(F.when(both, F.substr(c, F.lit(1), begin - 1)).otherwise(c)).alias("refined"), F.when(both, block).alias("block"))


def restore_prologue(c: Column, raw: Column) -> Column:
    """The heading Prologue set before a text that lost it."""
    told = lambda x: F.contains(F.lower(T.norm_line(x)), F.lit("prologue"))
    return F.when(told(raw) & ~told(c), F.concat(F.lit("Prologue\n"), c)).otherwise(c)


def output_text(json: Column) -> Column:
    """The text of a model service's JSON answer: output_text, or all text parts of its output."""
    parts = F.from_json(json, "output_text string, output array<struct<content:array<struct<text:string>>>>")
    inner = F.flatten(F.transform(parts["output"], lambda o: F.transform(F.coalesce(o["content"], F.array()), lambda x: x["text"])))
    joined = F.array_join(F.filter(inner, lambda x: x.isNotNull() & (x != "")), "")
    return F.coalesce(F.when(parts["output_text"] != "", parts["output_text"]), F.when(joined != "", joined))


def suggestions(c: Column) -> Column:
    """Glossary suggestions, ``key: value`` lines in blocks that --- parts, as an array of maps."""
    block = lambda b: F.map_from_entries(F.array_distinct(F.transform(F.filter(T.lines(b), lambda x: x.rlike("^\\s*[\\w-]+\\s*:")), lambda x: F.struct(F.lower(T.strip(F.substring_index(x, ":", 1))), T.strip(F.regexp_replace(x, "^[^:]*:", ""))))))
    return F.filter(F.transform(F.split(c, "(?m)^\\s*---\\s*$", -1), block), lambda m: F.size(m) > 0)
