import numpy as np
import pytest

from quire.llm import tokencount as tc
from quire.llm.shared import Tables, shared_path

from .helpers import corpus, documents


def test_counts_are_the_tokenizers(spark):
    rows = corpus()
    encoding = tc._encoding(open(tc.VOCABULARY, "rb").read())
    out = tc.count_tokens(spark, documents(spark, rows)).collect()
    assert sorted(r.n_tokens for r in out) == sorted(len(encoding.encode_ordinary(t or "")) for _, t in rows)
    assert all(r.closed for r in out)


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_is_brute_force(spark, tmp_path, width, block):
    rng = np.random.default_rng(block)
    want = []
    for f in range(3):
        ids = rng.integers(0, 4, 41 + f)
        ids[-1] = 3 if f else 1
        if f == 2:
            ids[5:9] = 3
        ids.astype(f"<u{width}").tofile(tmp_path / f"f{f}")
        start = no = 0
        for i, x in enumerate(ids):
            if x == 3:
                want.append((f"f{f}", no, start, i - start, True))
                start, no = i + 1, no + 1
        if start < len(ids):
            want.append((f"f{f}", no, start, len(ids) - start, False))
    (tmp_path / "f9").touch()
    got = tc.scan(spark, str(tmp_path), Tables(spark), end=3, width=width, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_empty(spark):
    assert tc.count_tokens(spark, documents(spark, corpus()).limit(0)).collect() == []
    assert shared_path(spark, "a") != shared_path(spark, "a")
