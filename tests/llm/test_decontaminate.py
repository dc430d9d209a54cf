import hashlib
import re

import pytest

from quire.llm import decontaminate as dc
from quire.llm.shared import Tables

from .helpers import corpus, documents, words

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def split_words(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(data)


def brute(text, items):
    w = split_words(text)
    hit, found = set(), set()
    for item, t in items:
        if item is None or t is None:
            continue
        q = split_words(t)
        m = min(10, len(q))
        for i in range(len(q) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == q[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def items():
    return [(1, words(1, 40)), (2, "Ünïcode ÇÀ"), (10, "short"), (10, words(3, 12)), (3, None), (None, words(2, 20)), (4, ""), (5, words(1, 12)), (6, "!!"), (7, "A-a a")]


def test_report_is_brute_force(spark):
    rows = corpus() + [(20, "Short, SHORT; ünïcode çà"), (21, "a a a a")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    got = sorted((tuple(r) for r in dc.report(spark, docs, bench).collect()), key=str)
    assert got == sorted(((d, *brute(t, items())) for d, t in rows), key=str)


@pytest.mark.parametrize("size", [40, 200])
def test_blocks_and_small_segments_give_the_same(spark, monkeypatch, size):
    docs = documents(spark, corpus())
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    want = sorted((tuple(r) for r in dc.report(spark, docs, bench).collect()), key=str)
    monkeypatch.setattr(dc, "BLOCK_BYTES", size)
    monkeypatch.setattr(dc, "SEGMENT_WORDS", 200)
    monkeypatch.setattr(dc, "CHUNK", 7)
    assert sorted((tuple(r) for r in dc.report(spark, docs, bench).collect()), key=str) == want


def test_empty_tables(spark):
    docs = documents(spark, corpus())
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 for r in dc.report(spark, docs, none).collect())
    assert dc.report(spark, docs.limit(0), none).collect() == []


def test_exact_and_near_matches(spark):
    tables = Tables(spark)
    docs = documents(spark, [(1, "one two three four five"), (2, "five four x three two one"), (3, "one " + "x " * 30 + "two three four five")])
    bench = spark.createDataFrame([(9, "one two three four five")], "item_id bigint, text string")
    index = dc.build_index(docs, tables)
    assert [tuple(r) for r in dc.matches(spark, index, bench, tables).collect()] == [(1, 9, 0, 5)]
    near = {r.doc_id for r in dc.matches(spark, index, bench, tables, slop=6).collect()}
    assert near == {1, 2}


def test_near_matches_need_a_repeated_term_as_often(spark):
    tables = Tables(spark)
    docs = documents(spark, [(1, "a b c"), (2, "a b a c a"), (3, "a b a c"), (4, "a " + "x " * 9 + "a a")])
    bench = spark.createDataFrame([(9, "a a a")], "item_id bigint, text string")
    near = dc.matches(spark, dc.build_index(docs, tables), bench, tables, slop=4).collect()
    assert {r.doc_id for r in near} == {2}


def test_clean_drops_only_contaminated_rows(spark):
    docs = documents(spark, corpus())
    bench = spark.createDataFrame([(1, words(1, 40))], "item_id bigint, text string")
    kept = dc.clean(spark, docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in corpus() if not brute(t, [(1, words(1, 40))])[4])


def test_equal_segments_keep_their_rows_in_any_number_of_blocks(spark, monkeypatch):
    rows = [(1, words(1, 40)), (2, words(9, 30))]
    other = [(None, "one two three"), (None, words(3, 12))]
    alike = [(None, "four five six"), (None, words(4, 12))]  # the same pattern of words as in other
    parts = [documents(spark, x).coalesce(1) for x in (rows, rows, other, alike)]
    docs = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    want = sorted(((d, *brute(t, items())) for d, t in rows * 2 + other + alike), key=str)
    for size in (dc.BLOCK_BYTES, 100):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        assert sorted((tuple(r) for r in dc.report(spark, docs, bench).collect()), key=str) == want
