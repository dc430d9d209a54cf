"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training tokens, as a table of segments: each holds the documents of
about SEGMENT_WORDS words, a number of its own, its vocabulary, and for each term the sorted positions at which it stands.  A segment
is whole for its documents, so a query needs no shuffle, whatever term or source is hot.  A phrase is found by
taking the postings of its rarest term in the segment, moved back by the term's offset, and intersecting them
with the moved postings of the next rarest until none or the occurrences are left.

The benchmark is a stated query set: it goes to the tasks in blocks of about BLOCK_BYTES of text, one after the other;
a block is released when its matches are written.  Documents with matches are merged over the blocks by segment and
number, and all others are taken from the index as they are, in the same way for any number of blocks.

Defined results.  A null or empty text has no words; it gets n_words 0.  A text of any length is one document of its
segment, which may then be longer than SEGMENT_WORDS.  Benchmark rows with a null item_id or text have no windows; rows
that repeat an item_id count as one item, and one window that several items have counts for each.  Repeated documents
each get their own row.  Empty tables give no rows, or rows without hits.  Only the columns named are read; others may
have any names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables, free_prefix

SEGMENT_WORDS = 1_000_000
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Candidates that are intersected at a time.
CHUNK = 2_000_000
#: Segments are large rows: few of them go to Python at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
#: A-Z lower-cased, and each byte that is not part of a word made a space.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

INDEX = "seg bigint, doc_ids array<bigint>, starts binary, lengths binary, terms binary, counts binary, postings binary"
PIECES = "seg bigint, doc_no int, spans array<bigint>, items array<bigint>"
COUNTED = "seg bigint, doc_no int, n_hit bigint, n_items bigint, items_sha256 string"
MATCHES = "doc_id bigint, item_id bigint, word int, length int"


def split_words(data: bytes) -> list[bytes]:
    return data.translate(TO_WORDS).split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("seg", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("starts", "lengths", "terms", "counts", "postings")]])

    def flush() -> pa.RecordBatch:
        n = np.array(lengths, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])  # one free position after each document
        term = np.fromiter(ids, dtype=np.int64, count=len(ids))
        keys = (term << 32) | (np.arange(len(term)) + np.repeat(np.arange(len(n)), n))
        keys.sort()
        postings = np.diff((keys & 0xFFFFFFFF).astype(np.uint32), prepend=np.uint32(0))  # steps compress well
        counts = np.bincount(term, minlength=len(vocabulary)).astype(np.int64)
        row = [next(names), doc_ids, starts.tobytes(), n.tobytes(), b" ".join(vocabulary), counts.tobytes(), postings.tobytes()]
        return pa.record_batch([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def fresh():
        v: defaultdict = defaultdict()
        v.default_factory = v.__len__  # a new term gets the next number
        return v, [], [], []

    names = count(TaskContext.get().partitionId() << 33)
    vocabulary, ids, lengths, doc_ids = fresh()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            found = split_words(text.as_py() or b"")
            if ids and len(ids) + len(found) > SEGMENT_WORDS or len(doc_ids) >= SEGMENT_WORDS:
                yield flush()
                vocabulary, ids, lengths, doc_ids = fresh()
            ids.extend(map(vocabulary.__getitem__, found))
            lengths.append(len(found))
            doc_ids.append(doc_id)
    if doc_ids:
        yield flush()


def build_index(docs: DataFrame, tables: Tables) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text)."""
    return tables.cut(docs.select("doc_id", "text").mapInArrow(_segments, INDEX), "postings")


class Queries:
    """Windows of benchmark items, as rows of term numbers, and the items that each window is from."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in split_words(text)], dtype=np.int32)
            if m := min(window, len(ids)):
                parts[m].append((np.lib.stride_tricks.sliding_window_view(ids, m), item))
        #: For each length: the windows, and for window i the items items[at[i]:at[i + 1]].
        self.groups = []
        for m, found in sorted(parts.items()):
            windows, of = np.unique(np.concatenate([w for w, _ in found]), axis=0, return_inverse=True)
            item = np.repeat(np.array([i for _, i in found], dtype=np.int64), [len(w) for w, _ in found])
            pairs = np.unique(np.stack([of.ravel(), item], axis=1), axis=0)
            self.groups.append((m, windows.astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))


class Segment:
    """One row of the index."""

    def __init__(self, row: dict):
        self.seg, self.doc_ids = row["seg"], row["doc_ids"]
        self.starts, self.lengths, self.counts = (np.frombuffer(row[c], dtype=np.int64) for c in ("starts", "lengths", "counts"))
        self.terms = {t: i for i, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.postings = np.cumsum(np.frombuffer(row["postings"], dtype=np.uint32), dtype=np.uint32).astype(np.int64)
        #: The postings lists one after the other, each position with its term above it: sorted as a whole.
        self.keys = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) | self.postings

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        i = np.searchsorted(self.keys, key)
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == key)

    def numbers(self, queries: Queries) -> np.ndarray:
        return np.array([self.terms.get(t, -1) for t in queries.terms], dtype=np.int64)

    def lists(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``term``, position) for all postings of all rows, about CHUNK at a time."""
        n = self.counts[term]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(term):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
            rows = np.repeat(np.arange(lo, hi), n[lo:hi])
            within = np.arange(len(rows)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            yield rows, self.postings[self.at[term[rows]] + within]
            lo = hi

    def phrases(self, windows: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first position) of each occurrence."""
        terms = number[windows]
        there = np.flatnonzero((terms >= 0).all(axis=1))
        if not len(there):
            return
        terms = terms[there]
        order = np.argsort(self.counts[terms], axis=1, kind="stable")  # rarest first
        for rows, position in self.lists(np.take_along_axis(terms, order[:, :1], 1)[:, 0]):
            first = position - order[rows, 0]
            rows, first = rows[first >= 0], first[first >= 0]
            for j in range(1, terms.shape[1]):
                offset = order[rows, j]
                keep = self.has(terms[rows, offset], first + offset)
                rows, first = rows[keep], first[keep]
                if not len(rows):
                    break
            if len(rows):
                yield there[rows], first

    def near(self, windows: np.ndarray, number: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term) where each of its terms stands, as often as the window has it, within ``slop`` words of that."""
        terms = number[windows]
        there = np.flatnonzero((terms >= 0).all(axis=1))
        if not len(there):
            return
        terms = terms[there]
        order = np.argsort(self.counts[terms], axis=1, kind="stable")
        for rows, position in self.lists(np.take_along_axis(terms, order[:, :1], 1)[:, 0]):
            doc = np.searchsorted(self.starts, position, "right") - 1
            lo = np.maximum(position - slop, self.starts[doc])
            hi = np.minimum(position + slop, self.starts[doc] + self.lengths[doc] - 1)
            for j in range(1, terms.shape[1]):
                t = terms[rows, order[rows, j]]
                # a term that the window has k times needs k postings from lo to hi
                again = sum((terms[rows, order[rows, i]] == t).astype(np.int64) for i in range(j))
                i = np.searchsorted(self.keys, (t << 32) | lo) + again
                keep = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= ((t << 32) | hi))
                rows, position, lo, hi = rows[keep], position[keep], lo[keep], hi[keep]
            if len(rows):
                yield there[rows], position

    def hits(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first positions, lengths) of the occurrences, merged, and the sorted pairs of document and item."""
        number, spans, pairs = self.numbers(queries), [], []
        for m, windows, at, items in queries.groups:
            for w, first in self.phrases(windows, number):
                spans.append(np.stack([first, np.full(len(first), m)], axis=1))
                n = at[w + 1] - at[w]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.searchsorted(self.starts, first, "right") - 1
                pairs.append(np.unique(np.stack([np.repeat(doc, n), items[np.repeat(at[w], n) + within]], axis=1), axis=0))
        spans = np.unique(np.concatenate(spans), axis=0) if spans else np.zeros((0, 2), dtype=np.int64)
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
        return spans[:, 0], spans[:, 1], pairs


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment(batch.slice(i, 1).to_pylist()[0])


def _covered(total: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _finder(queries):
    """The spans and items of the documents that have any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _rows(batches):
            first, length, pairs = seg.hits(queries.value)
            doc = np.searchsorted(seg.starts, first, "right") - 1
            some = np.unique(doc)
            span = zip(np.searchsorted(doc, some).tolist(), np.searchsorted(doc, some, "right").tolist(), strict=True)
            item = zip(np.searchsorted(pairs[:, 0], some).tolist(), np.searchsorted(pairs[:, 0], some, "right").tolist(), strict=True)
            spans = [np.stack([first[a:b] - seg.starts[d], length[a:b]], axis=1).ravel() for d, (a, b) in zip(some, span, strict=True)]
            items = [pairs[a:b, 1] for a, b in item]
            yield pa.record_batch([pa.array(np.full(len(some), seg.seg)), pa.array(some.astype(np.int32)), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=[c.split()[0] for c in PIECES.split(", ")])

    return find


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            s = np.array(r["spans"], dtype=np.int64).reshape(-1, 2)
            n_hit = int(_covered(int((s[:, 0] + s[:, 1]).max()), s[:, 0], s[:, 1]).sum())
            out.append((r["seg"], r["doc_no"], n_hit, len(r["items"]), _digest(r["items"])))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in COUNTED.split(", ")])


def _matcher(queries, slop: int | None):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _rows(batches):
            number = seg.numbers(queries.value)
            for m, windows, at, items in queries.value.groups:
                for w, first in seg.phrases(windows, number) if slop is None else seg.near(windows, number, slop):
                    n = at[w + 1] - at[w]
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc = np.searchsorted(seg.starts, first, "right") - 1
                    ids = pa.array(seg.doc_ids, pa.int64()).take(pa.array(np.repeat(doc, n)))
                    word = np.repeat(first - seg.starts[doc], n).astype(np.int32)
                    yield pa.record_batch([ids, pa.array(items[np.repeat(at[w], n) + within]), pa.array(word), pa.array(np.full(len(word), m, dtype=np.int32))], names=["doc_id", "item_id", "word", "length"])

    return match


def over_blocks(spark: SparkSession, items: DataFrame, window: int, find) -> DataFrame:
    """The union of ``find(block)`` over broadcast blocks of the benchmark (item_id, text), each of about BLOCK_BYTES of text."""
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for i in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # bounded by BLOCK_BYTES
        block = spark.sparkContext.broadcast(Queries([(r[0], r[1].encode()) for r in rows], window))
        part = find(block)
        block.destroy()
        out = part if out is None else out.union(part)
    return out


def matches(spark: SparkSession, index: DataFrame, items: DataFrame, tables: Tables, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc_id, item_id, word, length) of each occurrence of each item's windows.

    Without ``slop`` an occurrence is the exact phrase and ``word`` its first word's place; with it the window's
    words in any order, each as often as in the window and within ``slop`` words of the rarest, whose place is ``word``.
    """
    return over_blocks(spark, items, window, lambda block: tables.cut(index.mapInArrow(_matcher(block, slop), MATCHES), "matches", FEW_ROWS))


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: how many of its words are inside an occurrence of a window, and of which items."""
    tables = Tables(spark)
    index = build_index(docs, tables)
    found = over_blocks(spark, items, window, lambda block: tables.cut(index.mapInArrow(_finder(block), PIECES), "hits", FEW_ROWS))
    merged = found.groupBy("seg", "doc_no").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = tables.cut(merged.mapInArrow(_count, COUNTED), "counted")
    own = index.select("seg", "doc_ids", "lengths").mapInArrow(_documents, "seg bigint, doc_no int, doc_id bigint, n_words bigint")
    rows = own.join(counted, ["seg", "doc_no"], "left")
    none = F.lit(0).cast("bigint")
    out = rows.select("doc_id", "n_words", *[F.coalesce(c, none).alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", F.lit(_digest(()))).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
    out = tables.cut(out, "report")
    tables.drop(index)
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index's documents: their segment, number, doc_id and words."""
    for batch in batches:
        for seg, ids, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n = len(ids)
            yield pa.record_batch([pa.array(np.full(n, seg)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(np.frombuffer(lengths, dtype=np.int64))], names=["seg", "doc_no", "doc_id", "n_words"])


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    key, name = F.xxhash64(docs["doc_id"], docs["text"]), free_prefix(docs.columns) + "key"
    hits = report(spark, docs.select(key.alias("doc_id"), "text"), items, window)
    bad = hits.filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, key == bad[name], "left_anti")
