import numpy as np
import pytest

from quire.llm import langid as li
from quire.llm.shared import Tables

from .helpers import documents

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog while the children were playing with their friends in the garden",
    "fr": "le chien marche dans la rue avec une femme qui mange des pommes pour les enfants de la maison",
    "ru": "быстрая лиса прыгает через ленивую собаку пока дети играют в саду со своими друзьями",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TEXTS[k].split())), k, "s") for i, k in enumerate(sorted(TEXTS) * 60)]
    rows += [(900, "12 34 !", "en", "s"), (901, None, "fr", "s"), (902, "", None, "s"), (903, TEXTS["fr"], None, "s"), (None, TEXTS["ru"], "ru", "s")]
    return documents(spark, rows)


def test_held_out_rows(spark, docs):
    rows = {r.doc_id: r for r in li.report(spark, docs).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(rows[i].lang_pred == want[i] for i in range(180))
    assert any(rows[i].held_out for i in range(180))
    assert [(rows[i].lang_pred, rows[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert rows[903].lang_pred == "fr" and rows[None].lang_pred == "ru" and all(0 <= r.score <= 1 for r in rows.values())


def test_spans_of_a_mixed_text(spark, docs):
    model = li.fit(spark, docs.select("doc_id", "text", "lang"), Tables(spark))
    text = " ".join((TEXTS["en"], TEXTS["fr"], TEXTS["ru"]))
    got = sorted(tuple(r) for r in li.spans(spark, documents(spark, [(1, text)]), model).collect())
    assert [g[3] for g in got] == ["en", "fr", "ru"]
    assert text[got[1][1] : got[1][2]] == TEXTS["fr"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    costs = [rng.random((n, 3)).astype(np.float32) * 4 for n in (5, 0, 1, 7, 5)]
    for switch in (0.0, 0.7, 100.0):
        for c, path in zip(costs, li.viterbi(costs, switch), strict=True):
            if not len(c):
                assert len(path) == 0
                continue
            total = lambda p, c=c: sum(c[i, x] for i, x in enumerate(p)) + switch * sum(a != b for a, b in zip(p, p[1:], strict=False))
            best = min(total(p) for p in np.ndindex(*(3,) * len(c)))
            assert total(path.tolist()) == pytest.approx(best, abs=1e-4)


def test_nothing_to_learn_from(spark, docs):
    bare = documents(spark, [(1, "words here", None, "s"), (2, None, "en", "s")])
    assert {(r.lang_pred, r.score) for r in li.report(spark, bare).collect()} == {("und", 0.0)}
    assert li.report(spark, docs.limit(0)).collect() == []


def test_scripts_narrow(spark, docs):
    model = li.fit(spark, docs.select("doc_id", "text", "lang"), Tables(spark))
    costs = model.word_costs(["собака", "garden", "文"])
    ru = model.langs.index("ru")
    assert costs[0, ru] == 0 and (np.delete(costs[0], ru) == li.MOST).all() and costs[1, ru] == li.MOST


def test_numerals_are_no_letters(spark, docs):
    rows = documents(spark, [(1, "²³ ½", "en", "s"), (2, "Ⅷ ①", "en", "s"), (3, "٣ ४ 7", "en", "s"), (4, "x²", None, "s"), (5, "\u0301 \u0903", "en", "s")])
    got = {r.doc_id: r.lang_pred for r in li.report(spark, docs.union(rows.withColumn("doc_id", rows.doc_id + 5000))).collect() if r.doc_id and r.doc_id > 5000}
    assert [got[5000 + i] for i in (1, 2, 3, 5)] == ["und"] * 4 and got[5004] != "und"


def test_marks_stay_in_words():
    assert li.WORD.findall("नमस्ते दुनिया, e\u0301te\u0301 ไทยที่ a1b _c") == ["नमस्ते", "दुनिया", "e\u0301te\u0301", "ไทยที่", "a", "b", "c"]


def test_many_languages_keep_their_labels():
    rng = np.random.default_rng(3)
    costs = [rng.random((40, 300)).astype(np.float32) * 9]
    [path] = li.viterbi(costs, 0.0)
    assert path.tolist() == costs[0].argmin(axis=1).tolist() and path.max() > 127


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE", 6)
    rare = "這 是 罕 見 語 言 的 文 字 裡 面 有 很 多 漢 字"
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TEXTS["en"].split())), "en", "s") for i in range(400)] + [(1000 + i, rare, "zh", "s") for i in range(4)]
    out = {r.doc_id: r.lang_pred for r in li.report(spark, documents(spark, rows)).collect()}
    assert {out[1000 + i] for i in range(4)} == {"zh"} and out[5] == "en"
