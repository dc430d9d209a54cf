"""Rules and kernels on small literal cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import rewrite as W
from quire.functions import text as T
from quire.operators import chunks as K
from quire.operators import detect as D
from quire.operators import glossary as G
from quire.operators import lines as L
from quire.operators import model as X
from quire.operators import pairs as P
from quire.operators import quotes as QT
from quire.plans import fixtures as FX
from quire.sources import io


def one(spark, f, *texts):
    df = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
    return df.select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first().x


def lines_of(spark, f, text):
    return f(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()


@given(st.lists(st.sampled_from(["One two. ", "Three!", "\n\n", "word ", "“Oi.” ", "x" * 30]), max_size=40).map("".join), st.integers(5, 60))
@settings(max_examples=150, deadline=None)
def test_strict_chunks_lose_nothing(text, most):
    spans = K.strict_spans(text, most)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(a < b for a, b in spans)


def test_strict_chunks_end_behind_sentences():
    text = "First here. Second one is longer. Third."
    assert [text[a:b] for a, b in K.strict_spans(text, 20)] == ["First here.", " Second one is longer.", " Third."]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A linha foi\ncontinuada aqui.", "A linha foi continuada aqui."),
        ("A linha hife-\nnizada aqui.", "A linha hifenizada aqui."),
        ("Fim.\nnova linha", "Fim.\nnova linha"),
        ("Ele viu\n— olá", "Ele viu\n— olá"),
        ("TITULO GRANDE\ndepois", "TITULO GRANDE\ndepois"),
        ("uma linha com fim\n\n\nlonge daqui.", "uma linha com fim longe daqui."),
    ],
)
def test_safe_reflow(text, want):
    assert K.reflow_text(text)[0] == want
    assert K.reflow_text(want)[0] == want


def test_adjacent_lines():
    assert K.dedupe_text("Uma frase bem comprida aqui.\nUma frase bem comprida aqui.") == ("Uma frase bem comprida aqui.", {"lines_removed": 1, "blocks_removed": 0})
    assert K.dedupe_text("Crack!\nCrack!\nCrack!") == ("Crack!\nCrack!\nCrack!", {"lines_removed": 0, "blocks_removed": 0})


def test_repeated_passages_as_the_pattern_finds_them():
    rng, pattern = random.Random(4), re.compile(r"(.{12,}?)(?:\s+\1){1,}", re.S)
    for _ in range(1500):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.5:
            p = "".join(rng.choice("abcd ") for _ in range(rng.randint(10, 20)))
            text += p + rng.choice([" ", "", "  \n"]) + p
        assert D.repeats_at_once(text, 12) == bool(pattern.search(text))


def test_quotes():
    assert QT.mend_paragraphs("A fala começa” e segue.\n\nOutro”") == ("“A fala começa” e segue.\n\nOutro”", 1)
    assert QT.join_broken_speech("“Uma\n\nfala” e\n\noutra") == ("“Uma fala” e\n\noutra", 1)


def test_languages(spark):
    assert [T.language_code(x) for x in ("English", "japonês", "KR", "zh_TW", None)] == ["en", "ja", "ko", "zh", "auto"]
    with pytest.raises(ValueError, match="unknown"):
        T.language_code("klingon")
    for text, code in (("これは文です", "ja"), ("안녕하세요", "ko"), ("这是一个句子", "zh"), ("el perro que come con los gatos", "es"), ("nothing", "en"), ("", "en")):
        assert one(spark, T.detect_language, text) == code


@pytest.mark.parametrize(("text", "term", "sensitive", "want"), [("partial", "art", False, False), ("the Art of", "art", False, True), ("body freeze", "Freeze", True, False), ("a ação é", "aç", False, False), ("a ação é", "AÇÃO", False, True), ("これ第1章です", "第1章", False, True), ("a  b", "a b", False, True), ("x (y) z", "(y)", False, True)])
def test_terms(spark, text, term, sensitive, want):
    assert one(spark, lambda a, b: T.term_contains(a, b, F.lit(sensitive)), text, term) is want


def test_lines(spark):
    assert one(spark, T.lines, "a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, T.lines, "") == []
    assert lines_of(spark, L.dedupe_consecutive, "a\na\n“a\n“a\n\na\nb b\nb  b").text == "a\n“a\n“a\n\na\nb b"
    assert lines_of(spark, L.dedupe_prefix, "Era uma\nEra uma vez\n12\n12 anos").text == "Era uma vez\n12\n12 anos"
    assert lines_of(spark, L.remove_repeated, "\n".join(["SCAN GROUP"] * 6 + ["Story"])).text == "Story"
    assert [r.body for r in L.markdown_sections(spark.createDataFrame([(1, "pre\n# A\nx\n## B\ny")], "doc_id bigint, text string")).orderBy("section_no").collect()] == ["pre", "x", "y"]


def test_promo(spark):
    for text, want in (("Sign up for our newsletter", True), ('"Sign up for glory," he said', False), ("Visit us online", True), ("they join our side", False), ("see www.example.com", True)):
        assert one(spark, T.is_promo, text) is want


def test_detectors(spark):
    assert one(spark, D.collapse_reasons, " ".join(["palavra"] * 8)) == ["repeated_token_run"]
    assert one(spark, D.collapse_reasons, "\n".join(["uma linha bem comprida aqui"] * 3)) == ["repeated_lines"]
    assert one(spark, D.collapse_reasons, "") == ["empty"]
    assert one(spark, P.entity_mutation, "Mara viu. Depois Mara saiu.", "Maramente saiu.") is True
    assert one(spark, P.slash_mutation, "o menino", "do/a menino") is True
    assert one(spark, P.reuse_safe, "Capítulo 1 do livro", "Capítulo 2 do livro") is False
    assert one(spark, P.retry_reason, "Uma frase inteira para comparar.", "Uma") == "truncated"
    assert one(spark, P.retry_reason, "Uma frase.", "Uma frase.") == ""
    assert one(spark, T.classify_chunk, "“Oi.”\n“Tudo bem?”\nEle saiu.") == "dialogue"


def test_rewrites(spark):
    assert one(spark, W.fix_hyphen_breaks, "over-\nwhelming") == "over-whelming"
    assert one(spark, W.pair_straight_quotes, 'ele "disse" 5" e') == "ele “disse” 5\" e"
    assert one(spark, W.separate_narration, "Um.\nDois.\n— Fala.\nTrês.") == "Um.\n\nDois.\n— Fala.\nTrês."
    assert one(spark, W.leading_small_caps, "AFTER MARA watched") == "After Mara watched"
    assert one(spark, W.sentence_case_caps, "THE NIGHT WAS COLD") == "The night was cold"
    assert one(spark, W.unbreak, "uma li-\nnha\nsó\n\n# T\nx") == "uma linha só\n\n# T\n\nx"
    assert one(spark, W.between_markers, "x ### TEXTO_TRADUZIDO_INICIO\nolá\n### TEXTO_TRADUZIDO_FIM y") == "olá"
    assert one(spark, W.edit, "o o gato , aqui") == "o gato, aqui"
    assert one(spark, lambda c: W.edit(c, replacements={"a$b": "x\\y"}), "um A$B") == "um x\\y"
    assert one(spark, lambda c: W.edit(c, memory={"replacements": {"mara": "Mara", "": "x", "b": 3}, "past_preference": True}), "MARA, Era como se ela é b") == "Mara, era como se ela fosse b"
    assert one(spark, lambda c: W.edit(c, memory={"replacements": "none"}), "Era como se ele é") == "Era como se ele é"
    assert one(spark, W.output_text, '{"output":[{"content":[{"text":"a"},{"text":"b"}]}]}') == "ab"
    assert one(spark, W.suggestions, "key: Mara\npt: Mara\n---\nkey: Thread") == [{"key": "Mara", "pt": "Mara"}, {"key": "Thread"}]


def test_model_loop(spark):
    rows = spark.createDataFrame([(1, 0, "some words here"), (1, 1, "some words here"), (2, 0, "")], "doc_id bigint, chunk_idx bigint, text string")
    out = {(r.doc_id, r.chunk_idx): r for r in X.run(spark, rows, X.StubBackend(flaky=True)).collect()}
    assert out[1, 0].attempts == 2 and not out[1, 0].reused and out[1, 1].reused
    assert out[2, 0].status == "failed" and out[2, 0].output == ""


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"terms": [{"key": " Mara ", "pt": "Mara", "aliases": ["M", " "], "enforce": "sim"}, {"key": "", "pt": "x"}, {"key": "Edge", "pt": "Fio", "source_aliases": "E", "locked": "no", "forbidden_aliases": ["f"]}]}')
    rows = io.read_glossary(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.key, r.source_aliases, r.bad_aliases, r.locked, r.enforce) for r in rows] == [("Mara", ["M"], [], True, True), ("Edge", ["E"], ["f"], False, False)]
    assert io.noise_rules('{"line_regex": ["x"], "other": 1}')["line_regex"] == ["x"]
    assert io.noise_rules("broken")["max_line_len"] == 160
    assert io.load_config({"max_retries": 5, "unknown": 1, "cleanup_before_refine": False}).cleanup_before_refine == "off"


def test_volumes_and_texts(spark, tmp_path):
    (tmp_path / "Vol 3 - x.md").write_text("três\nlinhas")
    (tmp_path / "outro.md").write_text("um")
    assert {r.volume_key: r.text for r in io.read_volumes(spark, str(tmp_path)).collect()} == {"Vol 03": "três\nlinhas", "outro": "um"}
    assert io.mojibake_files(spark, str(tmp_path)).collect() == []


def test_issue_order_does_not_matter(spark):
    pairs = FX.pairs(spark)
    a = P.scores(pairs, P.issues(pairs, FX.pair_glossary(spark))).collect()
    b = P.scores(pairs.repartition(3), P.issues(pairs.repartition(2), FX.pair_glossary(spark))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_unbound_terms(spark):
    terms = spark.createDataFrame([FX._term(0, "第1章", "Capítulo 1"), FX._term(1, "Art", "Arte")], G.SCHEMA)
    texts = spark.createDataFrame([(1, "これ第1章です"), (2, "partial"), (3, "Art!")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.key) for r in G.select_terms(texts, terms).collect()) == [(1, "第1章"), (3, "art")]
