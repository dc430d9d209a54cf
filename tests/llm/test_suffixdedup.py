import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import suffixdedup as sd

from .helpers import corpus, documents, removed, words


def want_of(docs):
    rows = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    table = removed(rows)
    return sorted(((d, *table[d, t or ""]) for d, t, _ in rows), key=str)


def extra_rows():
    passage = words(20, 60)
    lines = [(100 + i, words(30 + i, 12) + " " + passage[: 150 + i] + " " + words(60 + i, 12)) for i in range(12)]
    return corpus() + lines + [(90, words(31, 200) * 2), (91, "ab" * 300), (92, "é" * 130), (93, "\x00" * 120)]


def test_report_is_brute_force(spark):
    docs = documents(spark, extra_rows())
    assert sorted((tuple(r) for r in sd.report(spark, docs).collect()), key=str) == want_of(docs)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_and_cut_documents_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_CLASSES", hot)
    monkeypatch.setattr(sd, "GROUP", 333)
    monkeypatch.setattr(sd, "BLOCK", 500)
    docs = documents(spark, extra_rows())
    assert sorted((tuple(r) for r in sd.report(spark, docs).collect()), key=str) == want_of(docs)


def test_index_is_brute_force():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 4):
        snippets = [bytes(rng.integers(97, 97 + letters, int(n)).tolist()) for n in rng.integers(100, 185, 25)]
        snippets += snippets[:5] + [snippets[0][:100], snippets[1][10:] + b"tail"]
        seen, want = set(), []
        for s in snippets:
            marks = []
            for i in range(len(s) - 99):
                marks.append(s[i : i + 100] in seen)
                seen.add(s[i : i + 100])
            want.append(marks)
        assert [m.tolist() for m in sd.index_repeats(snippets)] == want


def test_run_index_statistics():
    rng = np.random.default_rng(2)
    snippets = [bytes(rng.integers(97, 99, 130).tolist()) for _ in range(6)]
    text = np.frombuffer(b"".join(s + b"\xff" for s in snippets), dtype=np.uint8)
    left = np.concatenate([np.arange(130, -1, -1)] * 6)
    index = sd.RunIndex(text, left)
    whole = [bytes(text[i : i + left[i]]) + b"\xff" + int(i).to_bytes(4, "big") for i in range(len(text))]
    order = sorted(range(len(text)), key=whole.__getitem__)
    assert sd.suffix_array(text, left).tolist() == order
    common = lambda a, b: next(k for k in range(200) if k >= min(left[a], left[b]) or text[a + k] != text[b + k])
    want = {order[r]: common(order[r], order[r - 1]) if r else 0 for r in range(len(order))}
    assert index.statistics().tolist() == [want[i] for i in range(len(text))]
    assert len(index.first) < len(text)


def test_texts_are_cut_by_whole_characters(spark):
    passage = "çñü " * 40
    docs = documents(spark, [(1, "begin " + passage + "end"), (2, "x" + passage + "y é"), (3, None), (4, "")])
    out = {r.doc_id: r.text for r in sd.dedup_texts(spark, docs).collect()}
    assert out[1].startswith("begin ") and out[3] is None and out[4] == ""
    assert out[2].startswith("x") and out[2].endswith("y é") and len(out[2]) < 20
    assert sd.dedup_texts(spark, docs).columns == docs.columns


def test_empty(spark):
    docs = documents(spark, corpus()).limit(0)
    assert sd.report(spark, docs).collect() == []
    assert sd.dedup_texts(spark, docs).collect() == []


def test_filter_keeps_all_that_share_a_window():
    rng = np.random.default_rng(8)
    anchor = b"<the-anchor-gram>"[:16]
    snippets = []
    for _ in range(60):
        left, right = (bytes(rng.integers(97, 123, 84).tolist()) for _ in range(2))
        whole = left + anchor + right
        for _ in range(6):
            x = bytearray(whole)
            for i in rng.integers(0, 184, 3):
                if not 84 <= i < 100:
                    x[i] = 65
            snippets.append(bytes(x[int(rng.integers(0, 40)) : 184 - int(rng.integers(0, 40))]))
    twice = [anchor + b"y" * 40 + anchor + b"z" * 60, b"q" * 30 + anchor + b"y" * 40 + anchor + b"z" * 60]
    h = sd.gram_hash(np.frombuffer(anchor + bytes(1), dtype=np.uint8))[0]
    keep = sd.may_repeat(snippets, np.full(len(snippets), h))
    sets = [{s[i : i + 100] for i in range(len(s) - 99)} for s in snippets]
    for i, a in enumerate(sets):
        if any(a & b for j, b in enumerate(sets) if j != i):
            assert keep[i]
    assert not keep.all()
    assert sd.may_repeat(snippets + twice, np.full(len(snippets) + 2, h)).all()
