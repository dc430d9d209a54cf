"""Removal of repeated byte strings, by a run-length index over what may repeat.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller doc_id,
or earlier in the same document.

1. Each window of LENGTH bytes has an anchor, the GRAM bytes in it of least hash.  Equal windows have equal
   anchors, so consecutive windows of one anchor make a stretch, and only stretches whose anchor occurs twice can
   hold repeats.  Equal stretches (64 bits of the anchor's hash and 64 of the stretch's) are counted as one class with
   its first place; later members are repeats whole.  All counts are partial before a shuffle, and classes and anchors
   with a large share of the rows are broadcast to them (``join_unique``), so no common passage lands in one task.
2. The first members of classes that share an anchor with others go, with their bytes, to the anchor's task.  Over
   the stretches there a Burrows-Wheeler transform is built and run-compressed, with the suffixes at the ends of
   its runs sampled and their common prefixes measured.  Matching statistics are then streamed through the text
   from those samples: between samples each is one less than that before it, and so is the place of the suffix before
   it in order.  Windows whose statistic reaches LENGTH are linked with that place; of the windows linked with each
   other all but the first are repeats.  The suffix array itself is not part of the index.
3. Spans are joined to their documents.

An anchor of more than HOT_CLASSES classes is not gathered in a task: its windows are grouped by a 128-bit hash.
A document may be of any length: it is read in pieces of GROUP bytes.

Defined results.  A null or empty text has no bytes.  Null doc_ids come after all others.  Rows of one doc_id but
different texts are ordered by the texts' hash; rows equal in doc_id and text are one document, and each keeps the
same bytes.  Empty tables give no rows.  Other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables, free_prefix, join_unique

LENGTH = 100
GRAM = 16
#: Bytes of documents whose anchors are found together, and of stretches that are indexed together.
GROUP, BLOCK = 4 << 20, 1 << 20
HOT_CLASSES = 8192
NULL_DOC = (1 << 63) - 1
END = 0xFF  # no byte of UTF-8
SIDE = (LENGTH - GRAM) // 2
#: Odd multipliers of the gram hash.
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

STRETCHES = "ahash bigint, shash bigint, doc bigint, th bigint, s int, n int"
SNIPPETS = "ahash bigint, shash bigint, doc bigint, th bigint, s int, n int, classes bigint, data binary"
SPANS = "doc bigint, th bigint, spans array<int>"
REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def keyed(docs: DataFrame) -> DataFrame:
    """With doc and th, the document's place in the order."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(NULL_DOC)), "th": F.xxhash64("text")})


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as a little-endian number; the last 7 places are left out."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def gram_hash(data: np.ndarray) -> np.ndarray:
    w = words8(data)
    h = w[8:] >> np.uint64(29)
    h += w[8:] * K2
    h ^= w[:-8] * K1
    h ^= h >> np.uint64(32)
    h *= K3
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def stretches(data: bytes, begins: np.ndarray, sizes: np.ndarray):
    """For pieces of ``data``: (piece, first window, windows, anchor hash) of each stretch."""
    h = gram_hash(np.frombuffer(data, dtype=np.uint8))
    low = np.uint64((1 << 24) - 1)
    # the place fills the low bits, counted from the end: of equal hashes the last in the window is the anchor
    keys = h & ~low
    keys |= np.arange(len(h), dtype=np.uint64)[::-1]
    least = sliding_min(keys, LENGTH - GRAM + 1)
    at = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begins]))
    piece = np.searchsorted(begins, at, "right") - 1
    stop = (begins + sizes - LENGTH + 1)[piece]
    inside = at < stop  # windows across pieces are none
    at, piece, stop = at[inside], piece[inside], stop[inside]
    count = np.minimum(np.append(at[1:], len(data)), stop) - at
    anchor = len(h) - 1 - (least[at] & low).astype(np.int64)
    return piece, at, count, h[anchor]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
    """Groups of about GROUP bytes: the bytes, and (doc, th, offset in the document, begin, size) of each piece.

    A document above GROUP is cut into pieces that share LENGTH - 1 bytes, so each window is in one of them.
    """
    parts, rows, size = [], [], 0
    for batch in batches:
        for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            data = text.as_py() or b""
            for at in range(0, len(data) - LENGTH + 1, GROUP):
                piece = data[at : at + GROUP + LENGTH - 1]
                if size and size + len(piece) > GROUP + LENGTH:
                    yield b"".join(parts), rows
                    parts, rows, size = [], [], 0
                rows.append((doc, th, at, size, len(piece)))
                parts.append(piece)
                size += len(piece)
    if rows:
        yield b"".join(parts), rows


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STRETCHES.split(", ")]
    digest = xxhash.xxh3_64_intdigest
    for data, rows in _pieces(batches):
        doc, th, offset, begin, size = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        piece, at, n, ahash = stretches(data, begin, size)
        view = memoryview(data)
        ends = at + n + LENGTH - 1
        shash = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(at))
        cols = [ahash.view(np.int64), shash.view(np.int64), doc[piece], th[piece], (at - begin[piece] + offset[piece]).astype(np.int32), n.astype(np.int32)]
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in cols], names=names)


def repeated_stretches(docs: DataFrame, tables: Tables) -> DataFrame:
    """The stretches whose anchor occurs more than once, by STRETCHES."""
    rows = tables.cut(docs.select("doc", "th", "text").mapInArrow(_stretches, STRETCHES), "stretches")
    anchors = tables.cut(rows.groupBy("ahash").agg(F.count("*").alias("rows")).filter("rows > 1"), "anchors")
    out = tables.cut(join_unique(rows, anchors, ["ahash"], "inner"), "repeated-stretches")
    tables.drop(rows)
    tables.drop(anchors)
    return out


def stretch_classes(rows: DataFrame, tables: Tables) -> DataFrame:
    """(ahash, shash, rows, classes, fdoc, fth, fs): the classes of stretches, their first places and the classes of their anchors."""
    found = rows.groupBy("ahash", "shash").agg(F.min(F.struct("doc", "th", "s")).alias("first"), F.count("*").alias("rows"))
    found = tables.cut(found.select("ahash", "shash", "rows", F.col("first.doc").alias("fdoc"), F.col("first.th").alias("fth"), F.col("first.s").alias("fs")), "classes")
    anchors = tables.cut(found.groupBy("ahash").agg(F.count("*").alias("classes")).withColumn("weight", F.col("classes")), "anchors")
    out = tables.cut(join_unique(found, anchors, ["ahash"], "inner", weight="weight"), "stretch-classes")
    tables.drop(found)
    tables.drop(anchors)
    return out


def occurrences(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, th, whole, open): a document's stretches that are repeats whole, and those to be indexed."""
    rows = join_unique(rows, classes, ["ahash", "shash"], "inner")
    first = (F.col("doc") == F.col("fdoc")) & (F.col("th") == F.col("fth")) & (F.col("s") == F.col("fs"))
    whole = F.when(~first, F.struct("s", (F.col("s") + F.col("n") + LENGTH - 1).alias("e")))
    opened = F.when(first & (F.col("classes") > 1), F.struct("ahash", "shash", "s", "n", "classes"))
    rows = rows.select("doc", "th", whole.alias("whole"), opened.alias("open")).filter("whole is not null or open is not null")
    return rows.groupBy("doc", "th").agg(F.collect_list("whole").alias("whole"), F.array_distinct(F.collect_list("open")).alias("open"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SNIPPETS.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    for batch in batches:
        for doc, th, text, opened in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            data = text.as_py() or b""
            rows = [(o["ahash"], o["shash"], doc, th, o["s"], o["n"], o["classes"], data[o["s"] : o["s"] + o["n"] + LENGTH - 1]) for o in opened.as_py()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; ``left``: bytes before each place's END.  ENDs differ, an earlier one is less."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key = words8(padded)[:n].byteswap()  # the first byte counts most
    keep = np.minimum(left + 1, 8)
    mask = np.array([((1 << (8 * k)) - 1) << (64 - 8 * k) for k in range(9)], dtype=np.uint64)
    key = key & mask[keep]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (left[order[1:]] < 8)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 8
    while True:
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        at = order[rows]
        pair = (rank[at] << 32) | rank[np.minimum(at + k, n - 1)]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[rows] = at
        new[rows[1:]] |= pair[1:] != pair[:-1]
        rank[at] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        k *= 2


class RunIndex:
    """The run-compressed transform of a text: its runs' first bytes, and the suffixes sampled at the runs' ends.

    For each run: the place of its first suffix, that of the suffix before it in order (the last of the run before),
    and their common prefix.
    """

    def __init__(self, text: np.ndarray, left: np.ndarray):
        self.left = left
        order = suffix_array(text, left)
        before = np.where(order > 0, text[order - 1], END)
        head = np.ones(len(before), dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == END)
        heads = np.flatnonzero(head)
        first, last = order[heads], np.concatenate([[0], order[heads[1:] - 1]])
        by = np.argsort(first)
        self.bytes, self.first, self.before = before[heads][by], first[by], last[by]
        self.common = self._common(text, int(order[0]))

    def _common(self, text: np.ndarray, least: int) -> np.ndarray:
        """The common prefix of each run's first suffix with the suffix before it; none for the least suffix."""
        a, b = self.first, self.before
        most = np.minimum(self.left[a], self.left[b])
        most[a == least] = 0
        w = words8(np.concatenate([text, np.zeros(8, dtype=np.uint8)]))
        out, live, k = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            x = w[a[live] + k] ^ w[b[live] + k]
            differ = np.flatnonzero(x)
            lowest = x[differ] & (~x[differ] + np.uint64(1))
            zeros = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3
            out[live[differ]] = np.minimum(out[live[differ]], k + zeros)
            k += 8
            live = live[(x == 0) & (most[live] > k)]
        return out

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the place of the suffix before it in order and the length of their match, from the samples."""
        place = np.arange(len(self.left))
        run = np.searchsorted(self.first, place, "right") - 1
        beyond = place - self.first[run]
        return self.before[run] + beyond, self.common[run] - beyond

    def statistics(self) -> np.ndarray:
        return self.stream()[1]

    def repeats(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from each place on also start at an earlier place."""
        before, match = self.stream()
        out = np.zeros(len(match), dtype=bool)
        own = np.flatnonzero(match >= length)
        if not len(own):
            return out
        place = np.unique(np.concatenate([own, before[own]]))
        link = np.arange(len(place))
        link[np.searchsorted(place, own)] = np.searchsorted(place, before[own])
        while True:  # to the first in suffix order of the windows that are equal
            further = link[link]
            if (further == link).all():
                break
            link = further
        least = np.arange(len(place))
        np.minimum.at(least, link, np.arange(len(place)))
        out[place] = least[link] != np.arange(len(place))
        return out


def laid_out(snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The snippets in one text, each with END behind it; where they begin; their lengths."""
    text = np.frombuffer(b"".join(s + bytes([END]) for s in snippets), dtype=np.uint8)
    n = np.array([len(s) for s in snippets])
    return text, np.cumsum(n + 1) - n - 1, n


def may_repeat(snippets: list[bytes], anchors: np.ndarray) -> np.ndarray:
    """Which snippets may hold a window of another with the same anchor.

    A window has half of what it holds besides the anchor, SIDE bytes, on one side of it or the other.  A snippet
    that shares neither side with another shares no window.  Where one holds its anchor twice all of the anchor are kept.
    """
    text, at, n = laid_out(snippets)
    hit = np.flatnonzero(gram_hash(text) == np.repeat(anchors, n + 1)[: len(text) - GRAM + 1])
    owner = np.searchsorted(at, hit, "right") - 1
    keep = np.isin(anchors, anchors[np.bincount(owner, minlength=len(at)) != 1])
    once = ~keep
    place = np.zeros(len(at), dtype=np.int64)
    place[owner] = hit
    w = words8(np.concatenate([text, np.zeros(8, dtype=np.uint8)]))
    for begin, end in ((-SIDE, GRAM), (0, GRAM + SIDE)):
        rows = np.flatnonzero(once & (place + begin >= at) & (place + end <= at + n))
        if not len(rows):
            continue
        key = anchors[rows].copy()
        for o in [*range(begin, end - 8, 8), end - 8]:
            key ^= w[place[rows] + o]
            key *= K2
            key ^= key >> np.uint64(29)
        order = np.argsort(key)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        keep[rows[order[same]]] = keep[rows[order[same + 1]]] = True
    return keep


def index_repeats(snippets: list[bytes]) -> list[np.ndarray]:
    """For each snippet, in order, which of its windows occur at an earlier place of the snippets."""
    text, at, n = laid_out(snippets)
    left = np.repeat(at + n, n + 1) - np.arange(len(text))
    found = RunIndex(text, left).repeats(LENGTH)
    return [found[a:b] for a, b in zip(at.tolist(), (at + n - LENGTH + 1).tolist(), strict=True)]


def runs(marks: np.ndarray) -> list[int]:
    """Marked windows to the spans of bytes that they cover, as start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    out = edge.copy()
    out[1::2] += LENGTH - 1
    return out.tolist()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ahash, doc, th, s: blocks of whole anchors are indexed together."""

    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def done(table: pa.Table) -> pa.RecordBatch:
        rows = table.filter(pa.array(may_repeat(table["data"].to_pylist(), table["ahash"].to_numpy().view(np.uint64))))
        data = rows["data"].to_pylist()
        out = [(d, t, [s + x for x in runs(m)]) for d, t, s, m in zip(*[rows[c].to_pylist() for c in ("doc", "th", "s")], index_repeats(data), strict=True) if m.any()] if data else []
        return pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("data").nbytes
        if size > BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            ahash = table["ahash"].to_numpy()
            new = np.flatnonzero(np.diff(ahash)) + 1  # where an anchor's rows begin
            ends = np.cumsum(pc.binary_length(table["data"]).to_numpy())
            at = 0
            for cut in new.tolist():
                if ends[cut - 1] - (ends[at - 1] if at else 0) > BLOCK or cut == new[-1]:
                    yield done(table.slice(at, cut - at))
                    at = cut
            held = table.slice(at).to_batches()  # the last anchor's rows may go on
            size = sum(b.column("data").nbytes for b in held) if at else 0
    if held:
        yield done(pa.Table.from_batches(held))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for doc, th, s, n, data in zip(*[batch.column(c).to_pylist() for c in ("doc", "th", "s", "n", "data")], strict=True):
            h = np.frombuffer(b"".join(digest(data[i : i + LENGTH]) for i in range(n)), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(s, s + n), pa.int32())], names=["h1", "h2", "doc", "th", "s"])


def hot_spans(tables: Tables, snippets: DataFrame) -> DataFrame:
    """The repeats among windows of anchors with too many classes for one task."""
    rows = tables.cut(snippets.mapInArrow(_window_hashes, "h1 bigint, h2 bigint, doc bigint, th bigint, s int"), "hot-windows")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "s")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    first = tables.cut(first, "hot-first")
    late = join_unique(rows, first, ["h1", "h2"], "inner").filter(F.struct("doc", "th", "s") != F.col("first"))
    return late.select("doc", "th", F.array("s", F.col("s") + LENGTH).alias("spans"))


def repeat_spans(spark: SparkSession, docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc, th, spans): the spans of bytes, start, end, start, end ..., to be removed of documents that have any."""
    docs = keyed(docs.select("doc_id", "text"))
    rows = repeated_stretches(docs, tables)
    classes = stretch_classes(rows, tables)
    found = tables.cut(occurrences(rows, classes), "occurrences")
    tables.drop(rows)
    tables.drop(classes)
    opened = found.filter(F.size("open") > 0).select("doc", "th", "open")
    with_text = docs.select("doc", "th", "text").join(opened, ["doc", "th"]).select("doc", "th", "text", "open")
    snippets = tables.cut(with_text.mapInArrow(_cut_out, SNIPPETS), "snippets")
    cold = snippets.filter(F.col("classes") <= HOT_CLASSES).select("ahash", "doc", "th", "s", "data").distinct()
    cold = cold.repartition("ahash").sortWithinPartitions("ahash", "doc", "th", "s")
    spans = cold.mapInArrow(_index, SPANS).select("doc", "th", "spans")
    hot = snippets.filter(F.col("classes") > HOT_CLASSES)
    if not hot.isEmpty():
        spans = spans.union(hot_spans(tables, hot.distinct()))
    whole = found.filter(F.size("whole") > 0).select("doc", "th", F.flatten(F.transform("whole", lambda x: F.array(x.s, x.e))).alias("spans"))
    out = tables.cut(spans.union(whole).groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    tables.drop(found)
    tables.drop(snippets)
    return out


def merge(spans: list[int] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    if not spans:
        return []
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return data
    edges = [0, *[x for s in spans for x in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed so that no character of UTF-8 is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            data, spans = text.as_py() or b"", merge(spans)
            rows.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(keep(data, spans)).hexdigest()))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()])], names=names)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    tables = Tables(spark)
    spans = repeat_spans(spark, docs, tables)
    rows = keyed(docs.select("doc_id", "text")).join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_report, REPORT)


def _rewrite(names: list[str], found: str):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for t, s in zip(batch.column(batch.schema.names.index("text")).cast(pa.binary()), batch.column(batch.schema.names.index(found)).to_pylist(), strict=True):
                data = t.as_py()
                text.append(data if data is None else keep(data, whole_characters(data, merge(s))).decode())
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"text": pa.array(text, pa.string())}
            yield pa.record_batch([cols[n] for n in names], names=names)

    return rewrite


def dedup_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats removed from ``text``, by whole characters."""
    tables = Tables(spark)
    doc, th, found = (free_prefix(docs.columns) + k for k in ("doc", "th", "spans"))
    spans = repeat_spans(spark, docs, tables).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("spans").alias(found))
    rows = docs.join(spans, (F.coalesce(docs["doc_id"], F.lit(NULL_DOC)) == spans[doc]) & (F.xxhash64(docs["text"]) == spans[th]), "left").drop(doc, th)
    return rows.mapInArrow(_rewrite(docs.columns, found), docs.schema)
