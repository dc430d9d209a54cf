"""Review, repair, quality checks, glossary changes and the model loops."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import enforce as EN
from quire.operators import glossary as G
from quire.operators import model as M
from quire.operators import pairs as P
from quire.operators import prompts as PM
from quire.operators import repair as RP
from quire.operators import review as RV
from quire.plans import fixtures as FX

from .test_operators import one


def term(key, pt, **more):
    return {"key": key, "pt": pt, "category": None, "gender": None, "source_aliases": [], "bad_aliases": [], "allowed_target_aliases": [], "target_replacements": [], **more}


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("Eu wish e skills, SKILLS", [], "Quem me dera e habilidades, HABILIDADES"),
        ("o fio limite e o Fio Limite", [term("Thread Edge", "Fio Limite", bad_aliases=["fio limite"])], "o Fio Limite e o Fio Limite"),
        ("a Borda e a borda", [term("Edge", "Fio", bad_aliases=["borda"])], "a Fio e a Fio"),
        ("bordado", [term("Edge", "Fio", bad_aliases=["borda"])], "bordado"),
        ("o gume", [term("Edge", "Fio", target_replacements=[("gume", "corte")])], "o corte"),
        ("MARA VALE e MARA", [term("Mara Vale", "Mara Vale", category="personagem")], "Mara Vale e Mara"),
        ("Mara Mara Vale, Mara Vale Vale", [term("Mara Vale", "Mara Vale", category="personagem")], "Mara Vale, Mara Vale"),
        ("o Mara foi ao Mara, Do Mara, Mara como aliado", [term("Mara", "Mara", category="personagem", gender="feminino")], "a Mara foi à Mara, Da Mara, Mara como aliada"),
        ("a Rui foi à Rui", [term("Rui", "Rui", category="personagem", gender="masculino")], "o Rui foi ao Rui"),
        ("a Lua cheia", [term("Lua", "Lua", category="local", gender="masculino")], "a Lua cheia"),
    ],
)
def test_reviews(text, terms, want):
    assert RV.reviewed(text, terms)[0] == want


def test_review_of_rows(spark):
    rows = spark.createDataFrame([(1, "MARA viu a borda da borda"), (2, None), (3, "nada")], "doc_id bigint, text string")
    terms = spark.createDataFrame([FX._term(0, "Edge", "Fio", bad=["borda"]), FX._term(1, "Mara", "Mara", category="personagem")], G.SCHEMA)
    out = {r.doc_id: r for r in RV.review(rows, terms).collect()}
    assert out[1].text == "Mara viu a Fio da Fio" and Counter(out[1].replaced) == {"borda->Fio": 2, "MARA->Mara": 1}
    assert out[2].text == "" and out[3].text == "nada" and out[3].replaced == {}


def test_headings(spark):
    titles = F.array(F.lit("Prologue"), F.lit("Chapter 1"))
    assert one(spark, lambda c: RV.restore_headings(c, titles), "Era uma vez") == "# Prólogo\n\nEra uma vez"
    assert one(spark, lambda c: RV.restore_headings(c, titles), "# Prólogo\n\nEra") == "# Prólogo\n\nEra"


def test_repair_issues(spark):
    source = "“One.”\n“Two.”\n“Three.” And then they all went home together."
    rows = spark.createDataFrame([(1, source, "Um."), (2, "The Edge shone.", "O Edge brilhou muito ali."), (3, "Oi", "Oi")], "pair_id bigint, source string, target string")
    terms = spark.createDataFrame([FX._term(0, "Edge", "Fio", bad=["brilhou"])], G.SCHEMA)
    got = {(r.pair_id, r.type) for r in RP.repair_issues(rows, terms).collect()}
    assert got == {(1, "possible_dialogue_omission"), (1, "possible_dialogue_line_omission"), (1, "possibly_too_short"), (2, "source_term_leak"), (2, "bad_alias")}
    assert [r.detail for r in RP.repair_issues(rows).filter("type = 'possibly_too_short'").collect()] == ["ratio 0.05"]


@pytest.mark.parametrize(
    ("current", "candidate", "fault"),
    [
        ("um texto", " ", "empty_repair"),
        ("", "novo", None),
        ("palavra " * 100, "palavra " * 50, "repair_removed_content_ratio:0.50"),
        ("a\n\nb\n\nc\n\nd", "a\n\nb", "repair_removed_paragraphs:2/4"),
        ("“a”\n“b”\n“c”\n“d”", "“a”\n“b”\nc\nd e", "repair_removed_dialogue_lines:2/4"),
        ("Era uma vez uma casa muito grande ali\nfim", "Uma casa grande era uma vez ali no\nfim", "repair_removed_opening"),
        ("Era uma vez uma casa muito grande ali\nfim", "Era uma vez uma casa muito grande ali\nfim!", None),
    ],
)
def test_candidates(spark, current, candidate, fault):
    assert one(spark, RP.candidate_fault, current, candidate) == fault


def test_guard_and_structure(spark):
    assert one(spark, RP.guarded, "Mara viu. Mara saiu de casa.", "x", "Maramente saiu de casa ontem.") == "Mara viu. Mara saiu de casa."
    assert one(spark, RP.guarded, "Ela saiu de casa ontem cedo.", "x", "Ela saiu cedo de casa ontem.") == "Ela saiu cedo de casa ontem."
    assert one(spark, RP.guarded, "Ela saiu de casa ontem cedo.", "x", " ") == "Ela saiu de casa ontem cedo."
    assert one(spark, lambda a, b: RP.guarded(a, b, b, "translate"), "x", "Texto refinado: olá") == "olá"
    r = one(spark, RP.structure_regression, "“a”\n“b”\nc", "— a\n— b\nc")
    assert r.dialogue_style and not r.paragraphs and not r.lines
    r = one(spark, RP.refined_chunk, "“Oi.” “Olá.”\nfim", "“Oi.” “Olá.”\nfim\"\"\"")
    assert r.text == "“Oi.”\n\n“Olá.”\nfim" and r.ok and not r.soft_retry
    assert one(spark, RP.refined_chunk, "um\ndois", "um").ok is False
    assert one(spark, RP.refined_chunk, "“a” b", "“a” “b” c").soft_retry is True


def test_quality(spark):
    rows = spark.createDataFrame([(1, "She was.", "Mara era mais alto que ele. cuidadosa e atento. Chapter 3"), (2, "x", "O rosto de Mara era alto."), (3, "Los gatos con una casa", "Los gatos con una casa."), (4, "a", "fim.”* “Oi”“Olá”")], "pair_id bigint, source string, target string")
    people = spark.createDataFrame([(*FX._term(0, "Mara", "Mara", category="personagem")[:-1], "feminino")], G.SCHEMA)
    got = sorted((r.pair_id, r.type, r.found) for r in P.issues(rows, people).collect())
    assert [g for g in got if g[0] == 1] == [(1, "english_meta_text", "Chapter 3"), (1, "possible_gender_mismatch", "alto"), (1, "possible_gender_mismatch", "cuidadosa/atento")]
    assert {g[1] for g in got if g[0] == 2} == {"possible_gender_mismatch"}
    assert (3, "residual_source_language", "Los gatos con una casa.") in got
    assert {g[1] for g in got if g[0] == 4} == {"stray_format_marker", "missing_quote_spacing", "unbalanced_quotes", "malformed_quote_boundary"}
    report = {r.pair_id: r for r in RV.report(rows, people, most=1).collect()}
    assert report[1].score == 100 - 8 - 3 - 3 and report[1].truncated and report[1].by_type == {"english_meta_text": 1, "possible_gender_mismatch": 2} and report[3].source_language == "es"


def test_suggestions(spark):
    none = None
    manual = spark.createDataFrame([FX._term(0, "Edge", "Fio")], G.SCHEMA)
    dynamic = spark.createDataFrame([FX._term(0, "Torre", "Torre", locked=False), FX._term(1, "Rei", "Rei", locked=True)], G.SCHEMA)
    given = [(0, "Edge", "Fio", none, none), (1, "t", "TORRE", "local", none), (2, "r", "Rei", "pessoa", none), (3, "n", "Lua Nova", none, "nota"), (4, "n", "uma frase que é longa", none, none), (5, "t", "Torre", none, "alta")]
    out = G.apply_suggestions(manual, dynamic, spark.createDataFrame(given, "pos bigint, key string, pt string, category string, notes string")).collect()
    assert sorted((r.key, r.category, r.notes, r.locked) for r in out) == [("Lua Nova", None, "nota", False), ("Rei", None, None, True), ("Torre", "local", "alta", False)]


def test_glossary_identity(spark):
    a = spark.createDataFrame([FX._term(0, "A", "Á"), FX._term(1, "B", "B")], G.SCHEMA)
    b = spark.createDataFrame([FX._term(5, "B", "B"), FX._term(9, "A", "Á")], G.SCHEMA)
    c = spark.createDataFrame([FX._term(0, "A", "Â"), FX._term(1, "B", "B")], G.SCHEMA)
    h = [G.glossary_hash(x).first().hash for x in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_prompts(spark):
    text = one(spark, lambda c: PM.translation(c, F.lit("before"), F.lit("- a -> b"), F.lit("dialogue"), "ja", True), "texto")
    assert all(x in text for x in ("japonês", "honorifics", "CONTEXT", "before", "- a -> b", PM.PROFILES["dialogue"], PM.ADAPT, '"""texto"""', "### TEXTO_TRADUZIDO_INICIO"))
    assert "CONTEXT" not in one(spark, PM.translation, "t")
    prints = spark.range(1).select(*[c.alias(k) for k, c in PM.fingerprints("en").items()], PM.fingerprints("ko")["translate"].alias("other")).first()
    assert len(set(prints)) == 5


def test_loops(spark):
    docs = spark.createDataFrame([(1, "“He went home.”\n\nShe stayed there for a long while, and nobody came."), (2, None), (3, "# A\n\nlinha um\nlinha dois. ***")], "doc_id bigint, text string")
    out = M.translate(spark, docs, FX.pair_glossary(spark), M.StubBackend(flaky=True)).collect()
    assert {r.doc_id for r in out} == {1, 3} and all(r.status == "translated" and r.attempts == 2 for r in out)
    assert next(r.output for r in out if r.doc_id == 1).startswith("“He tnew emoh.”")
    refined = {r.doc_id: r for r in M.refine(spark, docs).collect()}
    assert refined[1].refined == 1 and refined[1].chunks == 1
    unbroken = {r.doc_id: r for r in M.unbreak(spark, docs).collect()}
    assert "mu" in unbroken[3].text or "linha" in unbroken[3].text


class Fixer:
    """Repairs what it is asked for."""

    def generate(self, prompt, attempt):
        if "Mend only" not in prompt:
            return "### TEXTO_TRADUZIDO_INICIO\num texto novo e inteiro em outra língua\n### TEXTO_TRADUZIDO_FIM"
        return "### TEXTO_REPARADO_INICIO\n" + "Tudo está no lugar agora, e ninguém ficou de fora.\n" + "### TEXTO_REPARADO_FIM"


def test_repair_loop(spark):
    rows = spark.createDataFrame([(1, 0, "All is in its place now, and nobody was left out of it.", "Tudo está aqui, sim."), (2, 0, "Fine as it is.", "Bem como está.")], "doc_id bigint, chunk_idx bigint, source string, output string")
    out = {r.doc_id: r for r in M.repair(spark, rows, Fixer()).collect()}
    assert out[1].output.startswith("Tudo está no lugar") and [i.type for i in out[1].issues] == ["possibly_too_short"]
    assert out[2].output == "Bem como está." and out[2].issues == []
    text = "Um parágrafo bom.\n\nle chat avec une dame pour les enfants mais"
    done = M.repair_segments(spark, spark.createDataFrame([(1, 0, text)], "doc_id bigint, chunk_idx bigint, text string"), Fixer(), "fr").first()
    assert done.replaced == 1 and done.text == "Um parágrafo bom.\n\num texto novo e inteiro em outra língua"


def test_missing_lines(spark):
    long = "this is a long line of a story that should be there in the end"
    raw = spark.createDataFrame([(1, f"front\nPrologue\n{long}\n{long}\nshort\nvisit us online {long}")], "doc_id bigint, text string")
    got = EN.missing_lines(raw, spark.createDataFrame([(1, "nothing")], "doc_id bigint, text string"), skip_front_matter=True).collect()
    assert [(r.line_no, r.line, r.before, r.after) for r in got] == [(2, long, "Prologue", long)]
