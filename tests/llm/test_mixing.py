import pytest

from quire.llm import mixing as mx

from .helpers import documents, split_ascii, words


def fill(sizes, weights, most=3):
    """Targets by resharing what is above the caps until nothing is."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * w[k] / sum(w[f] for f in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {k: most * sizes[k] for k in over}


def rows(n=300):
    out = []
    for i in range(n):
        source = ["a", "b", "b", "c", "é", None, "z", "z", "z"][i % 9]
        out.append((i, words(i, 1 + i * 7 % 60), "en", source))
    return out + [(1000, None, "en", "a"), (1001, "", "en", "only empty"), (None, "one two", "en", "a")] + [(2000, "same row again", "en", "hot")] * 150


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 50)])
def test_targets_and_takings(spark, weights):
    data = rows()
    out = mx.mix_report(spark, documents(spark, data), weights).collect()
    assert len(out) == len(data)
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(split_ascii(t))
    want = fill(sizes, weights)
    source = {r[0]: r[3] for r in data if r[0] not in (2000, None)}
    taken, largest = {}, {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id in source:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            taken[s] = taken.get(s, 0) + r.taken
            largest[s] = max(largest.get(s, 0), r.size)
    for s in taken.keys() - {"a"}:
        assert abs(taken[s] - want[s]) <= largest[s] + 3
    assert sum(fill(sizes, weights).values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_and_smaller_budgets_are_nested(spark):
    docs = documents(spark, rows()).repartition(5)
    take = lambda w: {(r.doc_id, r.size): r.taken for r in mx.mix_report(spark, docs, w).collect()}
    assert take((5, 2, 1)) == take((5, 2, 1))


def test_empty_and_wordless(spark):
    docs = documents(spark, rows())
    assert mx.mix_report(spark, docs.limit(0)).collect() == []
    assert [r.taken for r in mx.mix_report(spark, documents(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_mix_keeps_columns(spark):
    out = mx.mix(spark, documents(spark, rows()))
    assert out.columns == [*documents(spark, rows()).columns, "_quire_size", "_quire_source_size", "_quire_target", "_quire_taken"]


def test_main_path_is_native(spark):
    plan = mx.mix_report(spark, documents(spark, rows(9)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
