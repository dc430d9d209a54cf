import random
from difflib import SequenceMatcher

from quire.operators import chunks as K
from quire.plans import fixtures as FX


def test_near_chunks_are_brute_force(spark):
    unspaced = "".join(chr(0x4E00 + 7 * i) for i in range(41))
    long_words = "extraordinary transformations notwithstanding incomprehensible"
    texts = [unspaced, long_words, unspaced[:20] + "x" + unspaced[21:], long_words.replace("notw", "nxtw"), "", "short", "short", "shorter", "one two three four", "one two three five", unspaced[:30]]
    rows = [(d, i, t) for d in (1, 2) for i, t in enumerate(texts if d == 1 else texts[::-1])]
    want = [(d, i, j) for d, i, x in rows for e, j, y in rows if d == e and i < j and SequenceMatcher(None, x, y).ratio() >= 0.95]
    got = K.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id bigint, chunk_idx int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert (1, 0, 2) in want and (1, 1, 3) in want


def test_blocks_of_a_long_document(spark):
    """More texts than a block: every pair is found, in groups of two blocks at most."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30)]
    texts = []
    for i in range(70):
        if i % 3 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz ")
            texts.append("".join(t))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))))
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, i, t) for i, t in enumerate(texts[::-1][:9])]
    norm = lambda t: " ".join(t.split())
    want = [(d, i, j) for d, i, x in rows for e, j, y in rows if d == e and i < j and SequenceMatcher(None, norm(x), norm(y)).ratio() >= 0.95]
    got = K.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id bigint, chunk_idx int, text string"), block=8).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_the_literal_rows(spark):
    assert [tuple(r) for r in K.near_duplicate_pairs(FX.near_texts(spark)).collect()] == [(1, 0, 1)]
