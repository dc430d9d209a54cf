import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm import prefixtrie as pt
from quire.llm.shared import Tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, base string, digest string, chars int, part int, rows int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows):
    """Every beginning of every rebuilt conversation, by definition."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[c] for c in children[seq]) if children[seq] else 1
        saved[seq] = (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0) + sum(saved[c] for c in children[seq])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -(10**9), len(m), len(children[s]), leaves[s], saved[s], sha(ends.get(s, []))) for s, m in members.items())


def got(spark, rows, **how):
    out = pt.trie(spark, table(spark, rows), Tables(spark), **how).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in out)


def conversations(seed, n, most=7):
    rng = random.Random(seed)
    said = ["Hi", "How are you?", "", "Ünïcode 𝄞", None, "x" * 50]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(0, 450), rng.randint(-120, 30)])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said[: 2 + t])) for t in range(rng.randint(1, most))]
    return rows


AWKWARD = [(None, 1, "user", "lost"), (7, None, "user", "b"), (7, None, "user", "a"), (7, 0, "user", "c"), (7, 0, "user", "c"), (200, None, None, None), (5, 3, "", ""), (105, 1, "us", "er"), (106, 1, "user", ""), (2**62, 0, "user", "far")]


def test_trie_is_brute_force(spark):
    rows = conversations(1, 120) + AWKWARD
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("long", [0, 5])
def test_long_conversations_go_another_way(spark, long):
    rows = conversations(2, 60) + [(c, t, "user", f"t{t % 3}") for c in (100, 3, 300, 301, 317) for t in range(90)] + AWKWARD
    random.Random(3).shuffle(rows)
    assert got(spark, rows, long=long) == brute(rows)


def test_copies_of_one_conversation(spark, monkeypatch):
    rows = [(c, t, "user", "same") for c in range(0, 1500) for t in range(6)]
    assert got(spark, rows) == brute(rows)


def test_texts_of_ids_are_cut(spark):
    rows = [(b"a", i) for i in range(-5, 400)] + [(b"b", 7)]
    nodes = spark.createDataFrame([(k, [i]) for k, i in rows], "id binary, ends array<bigint>")
    out = {bytes(r.id): r.ends_sha256 for r in pt.ends_digests(nodes.repartition(5)).collect()}
    assert out == {b"a": hashlib.sha256(",".join(map(str, range(-5, 400))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []
