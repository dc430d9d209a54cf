"""Vector codes: product quantisation in integers, by Lloyd rounds that shuffle only what has changed.

Components become integers, vectors are cut into equal parts, and each part position has a codebook.  A round assigns
every part to its nearest entry in the tasks that hold the vectors and stores the assignments; parts whose assignment
differs from the stored one then give a minus to their old entry and a plus to their new one.  A task adds these up
before the shuffle, so a round moves at most one row an entry and task, whatever the number of vectors is.  Running
sums and counts of all entries are a stored table of ``parts`` x ``entries`` rows at most; an entry's new place is
floor(sum / count).  All arithmetic is exact, so results do not depend on how rows are dealt to tasks.

Defined results.  Rows whose vector is null or holds null or non-finite components are left out.  Vectors shorter than
the longest are filled with zeros, and so is the longest up to a positive multiple of ``parts``.  The first codebooks are the
vectors of the least ids, null ids last, equal ids by components; there are as many entries as vectors where these are
fewer than ``entries``.  Equal distances go to the lower entry; entries without parts stay.  Repeated rows are vectors
of their own.  Null labels are one label.  An empty table, or one without usable vectors, gives no rows.  Only the named
columns are read, whatever others are called.  Components that are too large for exact 64-bit sums of squares (over
2^27 after scaling, with 16 components a part) raise ValueError before any round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables, join_unique

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at once.
BLOCK = 2048


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part position: integers of shape (parts, entries, width)."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([book[i] for book, i in zip(self.entries, bytes.fromhex(code), strict=True)])


def usable(vector: Column) -> Column:
    """True where a vector is there and holds finite components alone."""
    infinite = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: fine(x.cast("double"))), F.lit(False))


def _nearest(x: np.ndarray, book: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x``, the nearest entry and its squared distance."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        if small:  # every term is an integer below 2^53, so floating point is exact
            p, b = part.astype(np.float64), book.astype(np.float64)
            d = (p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)
        else:
            d = np.stack([((part - entry) ** 2).sum(1) for entry in book], 1)
        at[i : i + BLOCK] = d.argmin(1)  # the first of equal ones
        far[i : i + BLOCK] = d.min(1)
    return at, far


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigner(books: np.ndarray, small: bool):
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            code, error = np.empty((len(v), parts), np.int32), np.zeros(len(v), np.int64)
            for p in range(parts):
                code[:, p], far = _nearest(v[:, p], books[p], small)
                error += far
            codes = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), parts).cast(pa.list_(pa.int32()))
            yield pa.record_batch([batch["id"], batch["label"], batch["v"], codes, batch["code"], pa.array(error)], names=["id", "label", "v", "code", "before", "error"])

    return assign


def _changes(shape: tuple[int, int, int]):
    """What the parts that changed add to the entries: a row for each entry of a task that is touched."""
    parts, entries, width = shape

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            v = _matrix(batch["v"], parts * width).reshape(-1, parts, width)
            new, old = _matrix(batch["code"], parts), _matrix(batch["before"], parts)
            for p in range(parts):
                moved = new[:, p] != old[:, p]
                for code, sign in ((new[moved, p], 1), (old[moved, p], -1)):
                    was = code >= 0  # in the first round there is none
                    np.add.at(total[p], code[was], sign * v[moved, p][was])
                    np.add.at(n[p], code[was], sign)
        at = np.argwhere((n != 0) | (total != 0).any(2))
        sums = [total[p, e].tolist() for p, e in at]
        yield pa.record_batch([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([n[p, e] for p, e in at], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return change


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int, scale: int) -> tuple[DataFrame, int, bool]:
    """(id, label, v, code) of usable vectors, their padded length, and whether sums of squares stay below 2^53."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    kept = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    n, longest, most = kept.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda x: F.abs(x))))).first()
    width = max(1, math.ceil((longest or 0) / parts))
    bound = math.ceil((most or 0.0) * scale) + 1
    if 4 * width * parts * bound**2 >= 1 << 63 or n * bound >= 1 << 63:
        raise ValueError("components are too large for exact integer sums")
    v = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    filled = F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * parts) - F.size("x")))
    none = F.array_repeat(F.lit(-1), parts)
    return kept.select("id", "label", filled.alias("v"), none.alias("code")), width, 4 * width * bound**2 < 1 << 53


def compress(spark: SparkSession, vectors: DataFrame, tables: Tables, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """A stored table of (id, label, v, code, before, error) of all usable vectors, and the codebooks of their codes.

    ``v`` is the integer vector, ``code`` an entry's number for each part, ``error`` the squared distance to what the
    code stands for, ``before`` the code of the round before.
    """
    state, width, small = _prepared(vectors, id_col, vector_col, label_col, parts, scale)
    first = state.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    shape = (parts, len(first), width)
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    label = state.schema["label"].dataType.simpleString()
    schema = f"id {state.schema['id'].dataType.simpleString()}, label {label}, v array<bigint>, code array<int>, before array<int>, error bigint"
    sums = spark.createDataFrame([], "part int, entry int, n bigint, total array<bigint>")
    for k in range(rounds + 1):
        after = tables.cut(state.mapInArrow(_assigner(books, small), schema), f"assigned-{k}")
        if k:
            tables.drop(state)
        state = after
        if k == rounds or not first:
            break
        moved = state.filter("code <> before").select("v", "code", "before").mapInArrow(_changes(shape), "part int, entry int, n bigint, total array<bigint>")
        added = sums.union(moved).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).cast("array<bigint>").alias("total"))
        running = tables.cut(added, f"sums-{k}")
        if k:
            tables.drop(sums)
        sums = running
        books = books.copy()
        for r in sums.filter("n > 0").collect():  # an entry each, parts x entries at most
            books[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return state, Codebooks(books)


def report(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable vector of ``vectors``."""
    tables = Tables(spark)
    state, books = compress(spark, vectors, tables)
    code = F.lower(F.array_join(F.transform("code", lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    key = [F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name")]
    rows = state.select(F.col("id").alias("vec_id"), code.alias("code"), "error", *key)
    of_label = tables.cut(rows.groupBy("unlabelled", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "labels")
    out = join_unique(rows, of_label, ["unlabelled", "name"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
