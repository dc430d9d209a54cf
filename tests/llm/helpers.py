"""Small documents with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string, doc string, th string, rows string, size string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); extra columns have names that operators use inside."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1]), "x", "y", "z", "r", "q") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, size=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    passage = words(1, 40)
    base = words(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "short"), (6, "short"), (7, words(3, 80) + " " + passage + " " + words(4, 50)), (8, passage), (9, "Ünïcode çà ñandú " + passage + " ß"), (10, "a" * 350), (11, words(5, 9000)), (None, base), (12, words(6, 30)), (12, words(6, 30)), (13, words(7, 60)), (13, words(8, 60)), (14, "  \t\n "), (15, "x" + "a" * 120), (16, words(9, 3)), (17, words(9, 4))]
    return rows


def split_ascii(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by definition; rows of equal doc_id and text are one document."""
    order = sorted({(r[0] is None, r[0] or 0, r[2], r[1] or "") for r in rows}, key=lambda x: x[:3])
    seen, out = set(), {}
    for null, doc_id, _, text in order:
        data = text.encode()
        mark = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        out[None if null else doc_id, text] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out
