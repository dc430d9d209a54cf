"""Rules over lines on literal cases, and what must hold for any text."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import rewrite as W
from quire.functions import text as T
from quire.operators import chunks as K
from quire.operators import detect as D
from quire.operators import lines as L
from quire.operators import prose as PR
from quire.operators import quotes as QT
from quire.sources.io import noise_rules

from .test_operators import lines_of, one

PIECES = ["One two", "three four.", "\n", "\n\n", "“Oi.” ", "— Olá", "***", "CHAPTER 1", "\nChapter 2\n", "SHOUT IT", "word ", "Prologue", "...", "visit us online", "12", "B UT ", "W E ", "a-b ", "ab "]
texts = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)
letters = lambda s: re.sub(r"\s+", "", s)


@pytest.mark.parametrize("rule", [prose.merge_gaps, prose.merge_wraps, prose.reflow, prose.wrap, prose.join_wrapped, prose.join_hard_wraps, prose.isolate_scenes])
@given(text=texts)
@settings(max_examples=60, deadline=None)
def test_joining_rules_keep_every_letter(rule, text):
    out, count = rule(text)
    assert letters(out) == letters(text) and count >= 0


@given(text=texts)
@settings(max_examples=60, deadline=None)
def test_normal_texts_stay(text):
    for rule in (prose.isolate_scenes, prose.dominant_hyphens):
        once = rule(text)[0]
        assert rule(once)[0] == once


@given(text=texts, most=st.integers(4, 60))
@settings(max_examples=100, deadline=None)
def test_quote_chunks_lose_nothing(text, most):
    spans = K.quote_spans(text, most)
    assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        (prose.merge_gaps, "he went to the\n\nold house.", "he went to the old house."),
        (prose.merge_gaps, "A\n\nb\n\nc", "A b\n\nc"),
        (prose.merge_gaps, "He said.\n\nThen left", "He said.\n\nThen left"),
        (prose.merge_gaps, "from\n\n“the bottom of his heart.”", "from “the bottom of his heart.”"),
        (prose.merge_gaps, "she turned\n\n“Who is it?”", "she turned\n\n“Who is it?”"),
        (prose.merge_gaps, "Chapter 1\nThe Start\n\nit began", "Chapter 1\nThe Start\n\nit began"),
        (prose.merge_wraps, "he went to the\nold house", "he went to the old house"),
        (prose.merge_wraps, "TITLE\nOf a book", "TITLE\nOf a book"),
        (prose.merge_wraps, "the end of\n\nthe line", "the end of the line"),
        (prose.reflow, "One line\nmore line.\n\n“Oi”\nEle saiu.", "One line more line.\n\n“Oi”\nEle saiu."),
        (prose.reflow, "Chapter 1\nThe Start\nIt began\nslowly", "Chapter 1\n\nThe Start\nIt began slowly"),
        (lambda t: prose.wrap(t, 8), "aaa bbb ccc ddd", "aaa bbb\nccc ddd"),
        (prose.respell_capitals, "W E RE FINALLY here.", "WERE FINALLY here."),
        (prose.respell_capitals, "I LOVED it", "I LOVED it"),
        (prose.respell_capitals, "K UN! Is it", "KUN! Is it"),
        (prose.join_wrapped, "uma linha\nque segue\nainda mais", "uma linha que segue\nainda mais"),
        (prose.join_wrapped, "uma linha\nque segue\n***", "uma linha\nque segue\n***"),
        (prose.join_hard_wraps, "uma linha\nque segue\n\n***", "uma linha\nque segue\n\n***"),
        (prose.isolate_scenes, "a\n***\nb\n\n\n\nc", "a\n\n***\n\nb\n\nc"),
        (prose.dominant_hyphens, "over-whelm overwhelm overwhelm overwhelm Ma-san Masan Masan Masan", "overwhelm overwhelm overwhelm overwhelm Ma-san Masan Masan Masan"),
        (prose.markdown_paragraphs, "# H\na\nb-\nc\n\n\n- x\n```\nq\n\n```\nz", "# H\na b c\n\n- x\n```\nq\n\n```\nz"),
        (prose.customised, "“Oi.”\n\ndisse Mara.", "— Oi. disse Mara."),
        (lambda t: prose.customised(t, False), "“Oi.”\n\ndisse Mara.", "“Oi.” disse Mara."),
        (prose.customised, "Gulp!\nPhew, poderam", "Glup.\nUfa, puderam"),
        (prose.join_attributions, "— Olá.\n\n— disse Mara\nFim", "— Olá. — disse Mara\nFim"),
        (prose.join_attributions, "— Olá.\n— ele disse", "— Olá.\n— ele disse"),
        (QT.balance, "“Oi. Ela saiu dali.", "“Oi.” Ela saiu dali."),
        (QT.balance, "uma fala longa” fim", "“uma fala longa” fim"),
        (QT.balance, "“a” “b”", "“a” “b”"),
        (PR.fragments, "Ele saiu de casa cedo. Ele saiu de casa cedo. Fim da linha.", "Ele saiu de casa cedo. Fim da linha."),
        (PR.fragments, "Não! Não! Não!", "Não! Não! Não!"),
    ],
)
def test_rules(rule, text, want):
    assert rule(text)[0] == want


def test_structure():
    text = "Capítulo 3\nO Começo do Fim\nEra uma vez.\n*** Depois\nMara Vale ALGUM TEMPO ANTES…\nDEPOIS QUE MARA viu\n# Capítulo 4: Sol\n\n# Capítulo 4\nfim"
    want = "# Capítulo 3: O Começo do Fim\n\nEra uma vez.\n***\n\nDepois\n\n## Mara Vale\n\nAlgum tempo antes…\n\nDepois que Mara viu\n# Capítulo 4: Sol\n\nfim"
    assert prose.structured(text) == want


def test_promotion():
    rules = noise_rules()
    text = "Story line one is here.\nSign up for our newsletter every week:\nFollow more at:\nOr visit us online:\n\nStory line two is here."
    assert prose.promo(text, rules) == ("Story line one is here.\nStory line two is here.", 3)
    assert prose.promo('"Sign up for glory," he said', rules)[1] == 0
    assert prose.promo("they chose to support us and join our side of it", rules)[1] == 0
    assert prose.promo("keep\ncustomspam here\nkeep too", noise_rules('{"line_contains": ["customspam"], "line_regex": []}'))[0] == "keep\nkeep too"


def test_contents():
    story = "It was a dark and stormy night, and he went home to see them all there."
    assert prose.contents_blocks(f"Table of Contents\nChapter 1\nChapter 2\nChapter 3\n\n{story}") == (f"\n{story}", 4)
    assert prose.contents_blocks(f"Newsletter\n{story}") == (story, 1)
    assert prose.strip_contents("Prologue\n1\nChapter 1\n2\nChapter 2\n3\nChapter 3\n4\n\nStory begins here")[0] == "Story begins here"
    assert prose.strip_contents("no marks")[0] == "no marks"


def test_answers():
    assert prose.refined_text("Aqui está o texto\n***\nOlá mundo\n***\nnotas") == "Olá mundo"
    assert prose.refined_text("cena\n***\nOlá\n***\nfim") == "cena\n***\nOlá\n***\nfim"
    assert prose.refined_text("# T\n### TEXTO_REFINADO_INICIO\nOlá\n### TEXTO_REFINADO_FIM x") == "# T\n\nOlá"
    assert prose.sanitized_refinement('a\nTexto refinado: b\n===GLOSSARIO_SUGERIDO_INICIO===\nkey: x') == "a"
    long = "uma passagem bem comprida que se repete sem parar aqui mesmo"
    text, counts = prose.sanitized(f"{long} {long}\nAs an AI language model\n<think>a</think>\n\ny\ny", D.repeats_at_once)
    assert text == f"{long}\ny" and counts == {"thinking": 1, "meta_lines": 1, "repeated_lines": 1, "repetitions": 1, "empty_lines": 1, "contaminated": 1}
    assert prose.sanitized("##\n\nOlá", D.repeats_at_once, strict=False)[0] == "Olá"


def test_quotes_as_the_source_tells():
    source, target = "“Ha ha. Come here, all of you.”", "“Ha ha.” Venham aqui, todos vocês.”"
    assert QT.source_aware(source, target) == ("“Ha ha. Venham aqui, todos vocês.”", 1)
    assert QT.source_aware("“a” b", '"a" b "') == ('"a" b ', 1)
    assert QT.source_aware("“a”", "“b”") == ("“b”", 0)


def test_repeats():
    assert K.dedupe_text("Uma frase bem comprida aqui.\nUma frase bem comprida aqui!")[1]["lines_removed"] == 1
    assert K.dedupe_text("— ?\n— ?") == ("— ?\n— ?", {"lines_removed": 0, "blocks_removed": 0})
    assert K.dedupe_text("Crack!\n" * 6)[0].count("Crack!") < 6
    assert K.has_repeats("uma frase longa aqui\n\numa frase longa aqui!") and not K.has_repeats("um\ndois")


def test_rows_are_never_lost(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a\na\nb"), (3, "a\nc")], "doc_id bigint, text string")
    for f in (L.dedupe_consecutive, L.collapse_lines, L.dedupe_prefix, L.remove_repeated, L.remove_numeric, L.remove_blank, L.remove_meta, L.remove_promo, L.collapse_paragraphs, L.remove_noise, L.strip_front_matter):
        out = f(rows).collect()
        assert [r.doc_id for r in out] == [1, 2, 3, 3] and [r.text for r in out[:2]] == ["", ""], f
    assert [r.text for r in L.dedupe_consecutive(rows).collect()][2:] == ["a\nb", "a\nc"]
    assert [(r.n_lines, r.max_length) for r in L.line_flags(rows).collect()] == [(0, 0), (0, 0), (3, 1), (2, 1)]
    assert [r.doc_id for r in PR.preprocess(rows).collect()] == [1, 2, 3, 3]
    assert [r.doc_id for r in L.top_repeated(rows).collect()] == [3, 3, 3, 3]


def test_line_operators_do_not_shuffle(spark):
    rows = spark.createDataFrame([(1, "a\na")], "doc_id bigint, text string")
    for f in (L.dedupe_consecutive, L.remove_repeated, L.top_repeated, L.line_flags, L.sections, L.markdown_sections, L.section_map):
        assert "Exchange" not in f(rows)._jdf.queryExecution().executedPlan().toString(), f


def test_preprocessing(spark):
    raw = "Visit us online\nThank you for reading\n\nPrologue\nIt was over-\nwhelming and he went to the\nold house.\n12\n“Who\n\nis it?” he asked.\nTHE NIGHT WAS COLD"
    out = lines_of(spark, PR.preprocess, raw)
    assert "isit us" not in out.text and "over-whelming" in out.text and "to the old house." in out.text and "12" not in out.text
    assert out.changes["promo"] == 1 and out.text.startswith("Prologue")
    calm = lines_of(spark, PR.preprocess, raw.rpartition("\n")[0]).text
    assert lines_of(spark, PR.preprocess, calm).text == calm
    assert lines_of(spark, lambda d: PR.preprocess(d, True), "Front\n" + raw).text.startswith("Prologue")


def test_expressions(spark):
    assert one(spark, W.mend_mixed_capitals, "RuMORS of  RuMORS") == "Rumors of rumors"
    assert one(spark, W.join_spaced_pairs, "W E go") == "WE go"
    assert one(spark, W.isolate_subtitle, "Chapter 1\n\nThe Last Lantern AFTER MARA left") == "Chapter 1\n\nThe Last Lantern\n\nAFTER MARA left"
    assert one(spark, W.close_dialogue, "“a”\n\n“b”\n\n“c”") == "“a”\n“b”\n“c”"
    assert one(spark, W.clean_text, "— algo\ncontinua\nfim.\n\n■◆x") == "— algo continua fim.\nx"
    assert one(spark, W.unbreak_output, '"""a-\nb\n"\nE- ele\n***\nc"""') == "a-b\nE-ele\n\n***\n\nc"
    assert one(spark, W.postprocess_translation, "Uh, I sei, — \n— Oi”, disse", "he parried it") == "Ah, Eu sei, —\n— Oi, disse"
    assert one(spark, W.postprocess_translation, "ele parriu", "he parried it") == "ele aparou"
    assert one(spark, W.separate_short_speeches, "Oi!\nOlá!\nEle saiu de casa e foi embora para longe") == "Oi!\n\nOlá!\nEle saiu de casa e foi embora para longe"
    assert one(spark, lambda c: W.split_suggestions(c)["block"], "x ===GLOSSARIO_SUGERIDO_INICIO=== key: a ===GLOSSARIO_SUGERIDO_FIM===") == "key: a"
    assert one(spark, W.restore_prologue, "texto", "Prologue\ntexto") == "Prologue\ntexto"
    assert one(spark, T.inline_html, "**a** & *b* __c__ _d_") == "<b>a</b> &amp; <i>b</i> <b>c</b> <i>d</i>"
    assert one(spark, T.heading_in_portuguese, "Chapter 12: The End") == "# Capítulo 12: The End"
    assert one(spark, T.heading_in_portuguese, "第3章 はじまり") == "# Capítulo 3: はじまり"
    assert one(spark, T.heading_in_portuguese, "Full Text") is None
    assert one(spark, T.with_heading, "Era uma vez", "Prologue") == "# Prólogo\n\nEra uma vez"
    assert one(spark, T.with_heading, "# Prólogo\n\nx", "Prologue") == "# Prólogo\n\nx"
    assert one(spark, T.snippet, "a" * 100 + " needle " + "b" * 100, "Needle") == "a" * 69 + " needle " + "b" * 69
    assert one(spark, T.base_url, "http://h:1/api/generate") == "http://h:1" and one(spark, T.base_url, "http://h/") == "http://h"
    assert one(spark, T.time_label, "Mara Vale ALGUM TEMPO ANTES…") == "Mara Vale"
    assert one(spark, lambda c: T.quality_cell(F.lit(90), F.array(c, c, F.lit("b"))), "a") == "90/100 (a:2, b:1)"
    assert T.residual_type("English") == "residual_english" and T.residual_type("ja") == "residual_source_language"
    assert one(spark, T.joined_sentences, "a\nb.\nc\n\nd") == "a b.\n\nc\n\nd"


def test_a_quote_closed_too_early_goes():
    source, early = "“One.” said", "“Um, disse” ela muito baixo” e"
    assert prose.early_close(source, early) == "“Um, disse ela muito baixo” e"
    assert prose.early_close(source, "“Um, disse” ela” e") == "“Um, disse” ela” e"
    assert prose.early_close(source, "“Um, disse”\n\nela muito baixo” e") == "“Um, disse”\n\nela muito baixo” e"
    assert prose.early_close("none", early) == early
    assert prose.extra_straight_quote("“One.”", '"Um." disse."') == '"Um." disse.' and prose.extra_straight_quote("“One.”", '"Um."') == '"Um."'
