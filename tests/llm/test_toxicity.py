import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as tx
from quire.llm.shared import Tables

from .helpers import corpus, documents, words

INSULTS = ("moron", "idiot", "worthless")


@pytest.fixture(scope="module")
def fitted(spark):
    rows = []
    for i in range(400):
        text = words(i, 40, size=200)
        if i % 5 == 0:
            text = text.replace(" ", f" {INSULTS[i // 5 % 3]} ", 1)
        rows.append((i, text))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(corpus())]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    return docs, labels, tx.fit(spark, docs, labels, Tables(spark))


def test_scores_separate_held_out_rows(spark, fitted):
    docs, labels, _ = fitted
    rows = tx.report(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} <= {False}
    want = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("h")).collect()}
    assert all(r.held_out == want[r.doc_id] for r in rows if r.doc_id is not None)


def test_disguised_words_are_restored(fitted):
    model = fitted[2]
    r = tx.Restorer(model.trigrams)
    for text in ("1d10t", "m0r0n", "m-o-r-o-n", "w0rthle$$", "iiidddiiiooottt"):
        assert any(w in INSULTS for w in r.restored(f"ab {text} cd")), text
    assert "moron" in r.restored("ab m o r o n cd")
    assert model.score("ab 1d10t cd", r, {}) >= 0.3 > model.score("ab cd", r, {})
    assert r.restored("plain words 2024 only") == []


def test_viterbi_is_the_best_path(fitted):
    r = tx.Restorer(fitted[2].trigrams)
    cost = fitted[2].trigrams

    def brute(token):
        paths = [((tx.GAP, tx.GAP), 0.0)]
        before = ""
        for c in token:
            paths = [(p if s < 0 else (*p, s), x + e + (0 if s < 0 else cost[p[-2]][p[-1]][s])) for p, x in paths for s, e in r.options(c, before, tx.REPEAT)]
            before = c
        p, _ = min(((p, x + cost[p[-2]][p[-1]][tx.GAP]) for p, x in paths), key=lambda v: v[1])
        return "".join(tx.ALPHABET[s] if s < 26 else "?" for s in p[2:])

    for token in ("1d10t", "m00r0n", "$c-um", "a1b!c"):
        assert r.best(token) == brute(token)


def test_trigrams_are_counted_over_all_texts(spark):
    docs = documents(spark, [(1, "ab"), (2, "AB  ab!"), (3, None), (4, "")])
    rows = docs.select("text").mapInArrow(tx._count_trigrams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = {r.gram: r.n for r in rows}
    gap, a, b = tx.GAP, 0, 1
    at = lambda x, y, z: (x * tx.SYMBOLS + y) * tx.SYMBOLS + z
    assert n[at(gap, a, b)] == 3 and n[at(a, b, gap)] == 3


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(0, 0), (1, 0)]])
def test_without_both_labels_scores_are_zero(spark, labels):
    docs = documents(spark, [(0, "a b"), (1, "c d"), (2, None)])
    rows = tx.report(spark, docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert [r.score for r in rows] == [0.0] * 3
    assert tx.report(spark, docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect() == []
