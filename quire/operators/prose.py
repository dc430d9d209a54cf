"""Rewriting of documents by rules that need Python, and the chains of them: preprocessing, clean-up, unbreaking.

A chain goes over the rows once; steps that are expressions run in Catalyst, the others between them in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import rewrite as W
from quire.functions import text as T
from quire.operators import chunks as K
from quire.operators import detect as D
from quire.operators import lines as L
from quire.operators import quotes as Q
from quire.operators.rows import rewritten
from quire.sources.io import noise_rules


def _of(f: Callable[[str], tuple[str, int]], counter: str) -> Callable[[DataFrame], DataFrame]:
    """The operator (doc_id, text, counter) of a rule."""
    return lambda docs: rewritten(docs.select("doc_id", "text"), f, [counter])


def promo(text: str) -> tuple[str, int]:
    return prose.promo(text, noise_rules())


def fragments(text: str) -> tuple[str, int]:
    return prose.without_repeated_fragments(text, K.alike(0.9))


merge_gaps = _of(prose.merge_gaps, "merged")
merge_wraps = _of(prose.merge_wraps, "merged")
reflow = _of(prose.reflow, "joined")
wrap_long = _of(prose.wrap, "cuts")
promo_blocks = _of(promo, "removed")
contents_blocks = _of(prose.contents_blocks, "removed")
strip_contents = _of(prose.strip_contents, "cut")
respell_capitals = _of(prose.respell_capitals, "respelled")
join_wrapped = _of(prose.join_wrapped, "joined")
join_hard_wraps = _of(prose.join_hard_wraps, "joined")
isolate_scenes = _of(prose.isolate_scenes, "fixes")
dominant_hyphens = _of(prose.dominant_hyphens, "replaced")
markdown_paragraphs = _of(prose.markdown_paragraphs, "joined")
repeated_fragments = _of(fragments, "removed")
structured = _of(lambda t: (prose.structured(t), 0), "none")
customised = _of(prose.customised, "changed")
attributions = _of(prose.join_attributions, "joined")
refinement = _of(lambda t: (prose.sanitized_refinement(t), 0), "none")
leading_noise = _of(lambda t: (prose.leading_noise(t), 0), "none")

SANITIZED = ["thinking", "meta_lines", "repeated_lines", "repetitions", "empty_lines", "contaminated"]


def sanitize(docs: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, text, counts, contaminated, status): a model's answers without talk and loops; an empty one is no error."""
    rows = rewritten(docs.select("doc_id", "text"), lambda t: prose.sanitized(t, D.repeats_at_once, strict), SANITIZED)
    return rows.withColumns({"contaminated": F.col("contaminated") == 1, "status": F.when(F.col("text") == "", "empty").when(F.col("contaminated") == 1, "contaminated").otherwise("ok")})


def _expression(docs: DataFrame, *steps: Callable[[Column], Column]) -> DataFrame:
    c = docs["text"]
    for step in steps:
        c = step(c)
    return docs.withColumn("text", c)


def _text(operator) -> Callable[[Column], Column]:
    """The text that a line operator makes."""
    return lambda c: operator.column(c)["text"]


def preprocess(docs: DataFrame, skip_front_matter: bool = False) -> DataFrame:
    """(doc_id, text, changes): the whole chain in its order; ``changes``: how much the steps that count have changed."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), F.coalesce("text", F.lit("")).alias("text"))
    drop = lambda c: F.replace(c, F.lit("￿"), F.lit(""))
    rows = _expression(rows, W.normalize_newlines, W.drop_invisible, drop, _text(L.remove_numeric))
    if skip_front_matter:
        rows = rewritten(_expression(rows, _text(L.strip_front_matter)), prose.strip_contents, ["contents_cut"])
    rows = _expression(rows, W.drop_footers)
    rows = rewritten(rows, lambda t: _both(t, {"promo": promo, "contents": prose.contents_blocks}), ["promo", "contents"])
    rows = _expression(rows, W.fix_hyphen_breaks, W.fix_ellipsis, W.squeeze_punctuation)
    rows = rewritten(rows, prose.respell_capitals, ["respelled"])
    rows = _expression(rows, W.join_spaced_pairs, W.mend_mixed_capitals)
    rows = rewritten(rows, prose.merge_wraps, ["wraps"])
    rows = _expression(rows, _text(L.remove_noise), _text(L.remove_repeated), _text(L.dedupe_consecutive))
    rows = rewritten(rows, lambda t: _both(t, {"gaps": prose.merge_gaps, "reflowed": prose.reflow}), ["gaps", "reflowed"])
    rows = _expression(rows, W.isolate_subtitle)
    rows = rewritten(rows, prose.wrap, ["long_lines"])
    rows = _expression(rows, W.sentence_case_caps, W.leading_small_caps, W.strip_inline_marks, W.close_dialogue)
    rows = rewritten(rows, Q.join_broken_speech, ["speeches"])
    counts = [c for c in rows.columns if c not in ("doc_id", "text", "raw")]
    changes = F.create_map(*[x for c in counts for x in (F.lit(c), F.col(c))])
    done = W.rewrite(F.col("text") if skip_front_matter else W.restore_prologue(F.col("text"), F.col("raw")), (("\n{3,}", "\n\n"),))
    return rows.select("doc_id", done.alias("text"), changes.alias("changes"))


def _both(text: str, steps: dict[str, Callable[[str], tuple[str, int]]]) -> tuple[str, dict[str, int]]:
    counts = {}
    for name, f in steps.items():
        text, counts[name] = f(text)
    return text, counts


def prepared_input(docs: DataFrame, most_chars: int = 0, reflowed: bool = False) -> DataFrame:
    """(doc_id, raw, text): a benchmark's input, cut if it is to be, preprocessed and reflowed."""
    raw = F.substring("text", 1, most_chars) if most_chars else F.col("text")
    rows = docs.select("doc_id", raw.alias("text"))
    ready = preprocess(rows).select("doc_id", "text")
    ready = K.safe_reflow(ready).select("doc_id", "text") if reflowed else ready
    return ready.select("doc_id", T.strip(F.col("text")).alias("text"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, reason, n): the audit of the lines that are taken for promotion or repeat too often, with their number."""
    runs = F.filter(L.line_runs(L.lines_of(docs["text"]), T.norm_line), lambda r: r["norm"] != "")
    reason = lambda r: F.when(T.is_promo(r["norm"]) & ~T.starts_speech(r["norm"]), "promo").when((r["n"] >= L.R.REPEAT_FREQUENCY) & (F.length(r["norm"]) <= L.R.REPEAT_LENGTH), "repeated")
    found = F.filter(F.transform(runs, lambda r: F.struct(r["norm"].alias("line"), reason(r).alias("reason"), r["n"].cast("bigint").alias("n"))), lambda x: x["reason"].isNotNull())
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.line", "x.reason", "x.n")


def suspicious_removals(docs: DataFrame) -> DataFrame:
    """Those of ``removed_lines`` that should be looked at again."""
    return removed_lines(docs).filter(T.is_suspicious_removal(F.col("line"), F.col("reason")))


def cleanup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, prefix_lines, lines_removed, blocks_removed, breaks, fragments): what is cleaned before a refinement."""
    rows = docs.select("doc_id", L.dedupe_prefix.column(docs["text"]).alias("s")).select("doc_id", "s.text", F.col("s.removed").alias("prefix_lines"))
    rows = rewritten(rows, K.dedupe_text, ["lines_removed", "blocks_removed"])
    rows = rows.select("*", K.glued(F.col("text")).alias("g")).select("doc_id", "prefix_lines", "lines_removed", "blocks_removed", F.col("g.text").alias("text"), F.col("g.breaks").alias("breaks"))
    return rewritten(rows, fragments, ["fragments"]).select("doc_id", "text", "prefix_lines", "lines_removed", "blocks_removed", "breaks", "fragments")


def needs_cleanup(docs: DataFrame) -> DataFrame:
    """(doc_id, repeats, glued): whether a text has lines that nearly repeat, or glued speeches."""
    return with_needs(docs).select("doc_id", "repeats", "glued")


def with_needs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, repeats, glued)."""
    rows = rewritten(docs.select("doc_id", "text"), lambda t: ("", int(K.has_repeats(t))), ["repeats"], into="flag")
    glued = F.col("text").rlike("(?m)" + K.R.GLUED[0]) | F.col("text").rlike(K.R.GLUED[1])
    return rows.select("doc_id", "text", (F.col("repeats") == 1).alias("repeats"), glued.alias("glued"))


def unbroken_globally(docs: DataFrame) -> DataFrame:
    """(doc_id, text, scenes, wraps, hyphens): what is normalised over a whole text after its chunks are unbroken."""
    rows = rewritten(docs.select("doc_id", "text"), lambda t: _both(t, {"scenes": prose.isolate_scenes, "wraps": prose.join_hard_wraps, "hyphens": prose.dominant_hyphens}), ["scenes", "wraps", "hyphens"])
    rows = _expression(rows, W.safe_dialogue_breaks)
    return rewritten(rows, lambda t: (prose.join_wrapped(t)[0], 0), ["none"]).drop("none")


def refined_finally(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the last steps over a refined text: marks, glued speeches, normalisers, the missing quote."""
    rows = _expression(refinement(docs).select("doc_id", "text"), W.structural)
    rows = rewritten(rows, lambda t: _both(t, {"speeches": Q.join_broken_speech}), ["speeches"])
    rows = _expression(rows, W.structural)
    out = rewritten(rows, lambda t: _both(t, {"custom": lambda x: prose.customised(x, dashes=False), "balanced": Q.balance}), ["custom", "balanced"])
    return out.select("doc_id", "text")
