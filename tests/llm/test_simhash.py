import numpy as np
import xxhash

from quire.llm import simhash as sh
from quire.llm.shared import Tables, components

from .helpers import corpus, documents, split_ascii


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = split_ascii(lowered)
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=4, raw=False):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    if raw:
        return label
    least = {}
    for i, r in zip(ids, label, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in label]


def test_report_is_brute_force(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in sh.report(spark, documents(spark, rows)).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    want = zip([d for d, _ in rows], [f"{p:016x}" for p in prints], brute_components([d for d, _ in rows], prints), strict=True)
    assert got == sorted(want, key=str)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 8)
    rng = np.random.default_rng(3)
    centre = 0x0123456789ABCDEF
    prints = {centre}
    while len(prints) < 150:
        p = centre
        for b in rng.choice(64, 3, replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 150)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    tables = Tables(spark)
    links = sh.near_links(spark, spark.createDataFrame(signed, "fp bigint"), tables)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 64 for r in links.collect())
    roots = {r.node: r.root for r in components(spark, links, tables).collect()}
    got = {p: roots.get(p, p) for (p,) in signed}
    want = brute_components(list(range(len(prints))), prints)
    groups = lambda keys: sorted(sorted(i for i, k in enumerate(keys) if k == v) for v in set(keys))
    assert groups([got[p] for (p,) in signed]) == groups(want)


def test_more_tables_for_more_fingerprints():
    assert [sh.choose_blocks(n)[0] for n in (1000, 10**8, 10**11)] == sorted(sh.choose_blocks(n)[0] for n in (1000, 10**8, 10**11))
    assert sh.choose_blocks(1000)[0] < sh.choose_blocks(10**11)[0]


def test_pivots_discard_no_pair():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    fp[200:] = fp[:200] ^ np.uint64(0b1011)
    i, j = map(np.ravel, np.meshgrid(np.arange(400), np.arange(400)))
    table = np.bitwise_count(fp[None] ^ sh.pivots()[:, None]).astype(np.int8)
    assert set(sh.pairs_within(fp, i, j, table, 4)) == set(np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= 4))


def test_pivots_discard_some_pairs():
    fp = np.random.default_rng(4).integers(0, 1 << 63, 200).astype(np.uint64)
    gone, survive = sh.pruned(fp)
    assert gone + survive == 199 * 100 and gone > survive > 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 200 + i) for i in range(50)] + [(5, 5), (7, 200)]
    out = {r.node: r.root for r in components(spark, spark.createDataFrame(links, "a bigint, b bigint"), Tables(spark)).collect()}
    assert out == {i: 100 for i in range(101, 141)} | {200 + i: 7 for i in range(50)}


def test_empty(spark):
    docs = documents(spark, corpus()).limit(0)
    assert sh.report(spark, docs).collect() == []
    assert sh.representatives(spark, docs).collect() == []


def test_representatives(spark):
    rows = corpus()
    kept = sh.representatives(spark, documents(spark, rows))
    prints = [brute_print(t) for _, t in rows]
    labels = brute_components([d for d, _ in rows], prints, raw=True)
    want = [min(d for (d, _), k in zip(rows, labels, strict=True) if k == v and d is not None) for v in set(labels)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == documents(spark, rows).columns
