"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

``pieces`` encodes documents, ends each with a separator and cuts only those that are longer than a sequence.  ``pack``
places the pieces.  A round sorts what is not yet placed and the gaps of open sequences together, by size from the
largest, in ranges; the task of a range sweeps it once: gaps become available as the sweep passes their size, a piece
takes its successor, the least available gap that holds it, and what is left of a gap is available again.  Pieces that
find no gap in their own range take those that earlier ranges have left over: both have ranks, and the numbers of
leftovers of each range say which ranks meet, so conflicts are resolved by one join of unique keys.  Gaps are updated and
the next round begins.  Before a round as many empty sequences are opened as the sizes prove to be necessary, and the
range of the largest pieces, which no other can serve, opens more where it has to; so every round places its largest
piece, and on one range a round is best-fit decreasing.

To the driver come, each round, a histogram of sizes (two rows for each length of a piece) and one row a range.  Items
of one size are spread over ranges by their numbers, so copies of one text make no range large.  Pieces shorter than
BUNDLE tokens are joined, as they are read, to units of at most twice that, so a sequence takes few rounds to fill.

Defined results.  A null text is an empty one: its document is a separator alone.  Texts of any length are encoded
whole.  Strings of special tokens in a text are ordinary text.  Repeated rows and null doc_ids are documents of their
own.  Ties go to the lower unit number, which follows the place of a row in its input partition.  An empty table has no
pieces.  Only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables

VOCABULARY, SEPARATOR, CAPACITY = "word_bpe_49k.json", 0, 2048
BUNDLE = 32
#: Items of a range; a vocabulary file above the second bound is not sent to the executors; words that a worker keeps.
RANGE, MOST_VOCABULARY, KNOWN = 100_000, 64 << 20, 1 << 20
#: Documents that meet in one batch.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "128"}
#: White space that parts the pieces of any text for the vocabulary, and characters that Python alone takes for it or that may be both.
ASCII_SPACE, DOUBTFUL = re.compile(r"[\x20\x09-\x0D]+"), "\x1c\x1d\x1e\x1f\x85"
#: Words that are surely split like this, whatever version of Unicode is asked: fixed values of the vocabulary's pattern.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ſ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones themselves, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """The ids of words, as little-endian bytes; those of whole texts follow, since no token crosses white space."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_str(vocabulary), _byte_letters()
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            tokens = self.model.tokenize
            ids = [t.id for p in SPLIT.findall(word.lower()) for t in tokens(p.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        words = ASCII_SPACE.split(text) if any(c in text for c in DOUBTFUL) else text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, unit bigint, place bigint, unit_length bigint"


def _cutter(vocabulary, separator: int, capacity: int, bundle: int, keep: bool):
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        number, small, held = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = [doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), number, 0, len(part) // 4, part if keep else None]
                    if row[3] >= bundle:
                        number += 1
                        out.append(row)
                        continue
                    small.append(row)
                    held += row[3]
                    if held >= bundle:
                        out += _bundled(small, number, held)
                        number, small, held = number + 1, [], 0
            yield _pieces(out, batch.schema.field(0).type)
        if small:
            yield _pieces(_bundled(small, number, held), small[0][0].type)

    return cut


def _bundled(rows: list[list], number: int, held: int) -> list[list]:
    place = 0
    for r in rows:
        r[5:8] = number, place, None if place else held
        place += r[3]
    return rows


def _pieces(rows: list[list], doc_id: pa.DataType) -> pa.RecordBatch:
    types = [doc_id, pa.int32(), *[pa.int64()] * 6, pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "unit", "place", "unit_length", "ids"]
    return pa.record_batch([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)


def pieces(spark: SparkSession, docs: DataFrame, tables: Tables, vocabulary: str | None = None, separator: int = SEPARATOR, capacity: int = CAPACITY, bundle: int = BUNDLE, keep_ids: bool = False) -> DataFrame:
    """A stored table of (doc_id, piece, start, length, ids_crc32, unit, place, unit_length, ids).

    Pieces of one ``unit`` stay together, each at its ``place``; the first one of a unit has its length.  ``ids`` are
    little-endian 32-bit ids if they are kept, else null.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError("the vocabulary file is too large to send to the executors")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}, ids binary"
    cut = _cutter(spark.sparkContext.broadcast(data), separator, capacity, min(bundle, capacity // 2), keep_ids)
    return tables.cut(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces", FEW_ROWS)


#: What a sweep says of an item: placed, a piece or a gap that is left over, a gap that only smaller pieces can use.
PLACED, PIECE, GAP, REST = range(4)
SWEPT = "part int, kind int, unit bigint, size int, seq bigint, gap int, rank bigint"


def _sweep(capacity: int):
    """Best fit within a range of items that come by size, largest first, gaps before pieces."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        gaps: list[list] = [[] for _ in range(capacity + 1)]  # the sequences of each gap, by number from the end
        have, rows, left, least = 0, [], 0, capacity
        for batch in batches:
            for size, is_piece, ident in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = size
                if not is_piece:
                    gaps[size].append(ident)
                    have |= 1 << size
                    continue
                fits = have >> size
                if fits:
                    gap = size + (fits & -fits).bit_length() - 1
                    seq = gaps[gap].pop()
                    if not gaps[gap]:
                        have ^= 1 << gap
                elif part == 0:
                    gap, seq = capacity, None
                else:
                    rows.append((PIECE, ident, size, None, None, left))
                    left += 1
                    continue
                if gap == capacity:
                    seq = ident  # the first unit of a sequence names it
                rows.append((PLACED, ident, size, seq, gap, None))
                if gap > size:
                    gaps[gap - size].append(seq)
                    have |= 1 << (gap - size)
        rank = 0
        for size in range(1, capacity + 1):
            for seq in reversed(gaps[size]):
                rows.append((GAP if size >= least else REST, None, None, seq, size, rank if size >= least else None))
                rank += size >= least
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
        yield pa.record_batch([pa.array([part] * len(rows), pa.int32()), *columns], names=["part", "kind", "unit", "size", "seq", "gap", "rank"])

    return sweep


def needed(sizes: np.ndarray, gaps: np.ndarray, capacity: int) -> int:
    """A number of new sequences that any packing needs: ``sizes`` and ``gaps`` count pieces and gaps by size."""
    at = np.arange(capacity + 1)
    above = lambda x: np.cumsum(x[::-1])[::-1]
    # what is as large as t goes only into gaps as large as t
    most = np.ceil((above(sizes * at) - above(gaps * at)) / capacity).max()
    for k in range(1, 9):  # no more than k pieces above 1/(k+1) of a sequence fit into one
        t = capacity // (k + 1) + 1
        most = max(most, np.ceil((sizes[t:].sum() - (gaps[t:] * (at[t:] // t)).sum()) / k))
    return max(0, int(most))


def _meetings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which leftover pieces meet which gaps: (range of pieces, from rank, to rank, range of gaps, difference of ranks).

    ``left`` has (range, pieces, gaps) by range; pieces take the least gaps that earlier ranges have left.
    """
    out, stack = [], []
    for part, n_pieces, n_gaps in left:
        rank = 0
        while rank < n_pieces and stack:
            top = stack[-1]
            m = min(n_pieces - rank, top[2] - top[1])
            out.append((part, rank, rank + m, top[0], top[1] - rank))
            rank, top[1] = rank + m, top[1] + m
            if top[1] == top[2]:
                stack.pop()
        if n_gaps:
            stack.append([part, 0, n_gaps])
    return out


def pack(spark: SparkSession, units: DataFrame, tables: Tables, capacity: int = CAPACITY, per_range: int = RANGE) -> DataFrame:
    """(unit, seq, at) of ``units`` (unit bigint, unit_length), whose numbers are unique and lengths within 1 and ``capacity``."""
    items = units.select(F.col("unit_length").cast("int").alias("size"), F.lit(1).alias("is_piece"), F.col("unit").alias("ident"))
    placed: list[DataFrame] = []
    stored = None
    while True:
        sizes, gaps = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for r in items.groupBy("size", "is_piece").count().collect():  # two rows a size at most
            (sizes if r.is_piece else gaps)[r["size"]] = r["count"]
        if not sizes.any():
            break
        new = needed(sizes, gaps, capacity)
        smallest = int(np.flatnonzero(sizes)[0])
        empty = spark.range(new).select(F.lit(capacity).alias("size"), F.lit(0).alias("is_piece"), F.col("id").alias("ident"))
        both = items.filter(F.col("size") >= smallest).union(empty)
        ranges = max(1, -(-int(sizes.sum() + gaps[smallest:].sum() + new) // per_range))
        order = [F.col("size").desc(), F.col("is_piece"), F.col("ident")]
        # the last items, ``per_range`` at most, are one range; there is nothing to sample then
        dealt = both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)
        swept = dealt.sortWithinPartitions(*order).mapInArrow(_sweep(capacity), SWEPT)
        swept = tables.cut(swept, f"swept-{len(placed)}")
        if stored is not None:
            tables.drop(stored)
        of = lambda kind: F.count(F.when(F.col("kind") == kind, True))
        left = swept.filter(F.col("kind").isin(PIECE, GAP)).groupBy("part").agg(of(PIECE).alias("p"), of(GAP).alias("g")).collect()  # one row a range
        meet = _meetings(sorted((r.part, r.p, r.g) for r in left))
        # as many meetings as twice the ranges at most
        met = spark.createDataFrame(meet, "of int, low bigint, high bigint, gap_part int, shift bigint")
        waiting = swept.filter(F.col("kind") == PIECE).select("part", "unit", "size", "rank")
        waiting = waiting.join(F.broadcast(met), (F.col("part") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        paired = waiting.filter("gap_part IS NOT NULL").select("unit", "size", F.col("gap_part").alias("part"), (F.col("rank") + F.col("shift")).alias("rank"))
        free = swept.filter(F.col("kind") == GAP).select("part", "rank", "seq", "gap")
        joined = tables.cut(free.join(paired, ["part", "rank"], "left"), f"joined-{len(placed)}") if meet else free.select("*", F.lit(None).cast("bigint").alias("unit"), F.lit(None).cast("int").alias("size"))
        seq = F.when((F.col("gap") == capacity) & F.col("unit").isNotNull(), F.col("unit")).otherwise(F.col("seq"))
        joined = joined.select("unit", "size", seq.alias("seq"), "gap")
        at = (F.lit(capacity) - F.col("gap")).cast("bigint").alias("at")
        placed.append(swept.filter(F.col("kind") == PLACED).select("unit", "seq", at))
        if meet:
            placed.append(joined.filter("unit IS NOT NULL").select("unit", "seq", at))
        gap = F.col("gap") - F.coalesce("size", F.lit(0))
        after = [
            waiting.filter("gap_part IS NULL").select("size", F.lit(1).alias("is_piece"), F.col("unit").alias("ident")),
            joined.select(gap.alias("size"), F.lit(0).alias("is_piece"), F.col("seq").alias("ident")),
            swept.filter(F.col("kind") == REST).select(F.col("gap").alias("size"), F.lit(0).alias("is_piece"), F.col("seq").alias("ident")),
        ]
        stored = items = tables.cut(reduce(DataFrame.union, after).filter("size > 0"), f"items-{len(placed)}")
    return reduce(DataFrame.union, placed) if placed else units.select("unit", F.col("unit").alias("seq"), F.lit(0).cast("bigint").alias("at"))


def packed(spark: SparkSession, docs: DataFrame, tables: Tables, capacity: int = CAPACITY, keep_ids: bool = False, **how) -> DataFrame:
    """Each piece of ``docs`` with its ``sequence_id`` and its ``offset`` there."""
    cut = pieces(spark, docs, tables, capacity=capacity, keep_ids=keep_ids, **how)
    whole = F.col("unit_length") == capacity  # these fill a sequence
    places = tables.cut(pack(spark, cut.filter(F.col("unit_length").isNotNull() & ~whole), tables, capacity), "places")
    rest = cut.filter(~F.coalesce(whole, F.lit(False))).join(places, "unit")
    out = [rest.select(*cut.columns, F.col("seq").alias("sequence_id"), (F.col("at") + F.col("place")).alias("offset")), cut.filter(whole).select("*", F.col("unit").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    return reduce(DataFrame.union, out)


def sequences(spark: SparkSession, docs: DataFrame, tables: Tables, capacity: int = CAPACITY, **how) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids): the packed sequences, little-endian 32-bit ids, ``capacity`` at most each."""
    rows = packed(spark, docs, tables, capacity, keep_ids=True, **how)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), ids.alias("ids"))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return packed(spark, docs, Tables(spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
