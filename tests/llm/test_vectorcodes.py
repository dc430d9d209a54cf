import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import vectorcodes as vc
from quire.llm.shared import Tables

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, code string, rows int, name string"


def table(spark, rows):
    floats = lambda e: e and [None if c is None else float(c) for c in e]
    return spark.createDataFrame([(i, floats(e), x, "a", "b", "c", 1, "d") for i, e, x in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd over all parts, in Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e], x) for i, e, x in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), x) for i, v, x in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                members.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, x in kept:
        found = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[x] = by_label.get(x, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, x))
    return sorted(((i, c, e, by_label[x], sha) for i, c, e, x in out), key=str)


def vectors(seed, n, dim=8, spread=9):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 64 + rng.choice([0, 0.0001]) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_report_is_lloyd(spark):
    rows = vectors(1, 280)
    assert got(vc.report(spark, table(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(7, [1.0, 2, 3, 4], 1), (7, [1.0, 2, 3, 4], 1), (7, [0.5, 2, 3, 4], 2), (None, [0.0, 0, 0, -1], None), (1, None, 1), (2, [1.0, None, 2, 3], 1), (3, [1.0, float("nan"), 2, 3], 1), (4, [float("-inf"), 0, 0, 0], 1), (5, [0.25, 0.5], None), (6, [], 3), (-3, [0.1, 0.1, 0.1, 0.1, 0.1], 3)]
    out = got(vc.report(spark, table(spark, rows)))
    assert out == brute(rows) and len(out) == 7


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_little_or_nothing(spark, rows):
    assert got(vc.report(spark, table(spark, rows))) == brute(rows)


def test_hot_label_and_copies(spark):
    rows = vectors(2, 60) + [(100 + i, [0.5] * 8, 1) for i in range(300)]
    assert got(vc.report(spark, table(spark, rows).repartition(7))) == brute(rows)


def test_wide_components_take_the_other_way(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-(1 << 17), 1 << 17)) for _ in range(16)], i % 3) for i in range(40)]
    assert got(vc.report(spark, table(spark, rows))) == brute(rows)
    with pytest.raises(ValueError, match="too large"):
        vc.report(spark, table(spark, [(1, [3e38] * 8, 1)]))


def test_rounds_shuffle_changes_alone(spark):
    """The running sums are the sums of the members of each entry, though later rounds add only differences."""
    rows = vectors(4, 200)
    tables = Tables(spark)
    state, books = vc.compress(spark, table(spark, rows), tables, entries=16, rounds=3)
    again = brute(rows, entries=16, rounds=3)
    assert books.digest() == again[0][-1]
    r = state.first()
    assert sum((books.decode(bytes(r.code).hex()) - np.array(r.v)) ** 2) == r.error
