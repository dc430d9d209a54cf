"""The matcher's ratio is bounded by the longest common subsequence, and few pairs need the matcher."""

import random
from difflib import SequenceMatcher

from quire.operators import chunks as K


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_order_and_ratio_are_those_of_plain_forms():
    r = random.Random(5)
    for _ in range(300):
        a = "".join(r.choices("abcä日 ", k=r.randint(0, 40)))
        b = "".join(c for c in a if r.random() > 0.1) + "".join(r.choices("ab ", k=r.randint(0, 3))) if r.random() < 0.7 else "".join(r.choices("abc", k=r.randint(0, 40)))
        assert K.in_common_order(a, b) == _subsequence(a, b)
        for least in (0.5, 0.9, 0.95, 1.0):
            assert K.ratio_at_least(a, b, least) == (SequenceMatcher(None, a, b).ratio() >= least)


def test_texts_of_the_same_letters_in_another_order_need_no_matcher(monkeypatch):
    words = ["lamp", "river", "stone", "cloud", "paper", "window", "garden", "silver"] * 40
    a, b = (" ".join(random.Random(n).sample(words, len(words))) for n in (1, 2))
    monkeypatch.setattr(K, "SequenceMatcher", None)
    assert sorted(a) == sorted(b) and not K.ratio_at_least(a, b, 0.95)
