"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints are made a document at a time.  Equal fingerprints are one node, so copies cost nothing after that.
The distance table holds, for each node, its Hamming distances to the PIVOTS reference fingerprints; it is computed
once and stored.  By the triangle inequality two nodes whose distances to any pivot differ by more than RADIUS are no
pair, so pairs are discarded by their largest coordinate difference, and survivors are verified.  Pivots alone
would leave a share of all pairs to look at, which grows with the square of the corpus.  Therefore only nodes meet
that can be within RADIUS by their bit blocks: such a pair agrees on at least ``blocks - RADIUS`` of ``blocks`` blocks,
and each node is listed once for each choice of that many blocks; ``choose_blocks`` takes the cheapest number of
blocks for the number of nodes.  Both are exact.  ``pruned`` counts what the pivots discard.

A bucket of more than CHUNK nodes is cut into chunks, and each pair of chunks is a bucket of its own, so the work on
a hot bucket is spread over as many tasks as it has pairs of chunks.
Tasks return, in place of all pairs, a spanning forest of the pairs that they have found: no link between two
texts is lost to a component, and there are at most as many rows as fingerprints.

Defined results.  A null or empty text has fingerprint 0 and is linked as any other.  Fewer words than a shingle
make one shingle.  A text of any length is fingerprinted whole, AT_ONCE shingles at a time.  A null doc_id counts as
larger than all others; a component of such rows alone has a null id.  A bit set in exactly half the shingles is 0.
Repeated rows each get their row.  An empty table gives no rows.  Other columns, whatever their names, are not read
by ``report`` and pass through ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables, components, free_prefix, join_unique

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = 24
#: Fingerprints of one bucket that are compared in one task.
CHUNK = 4096
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Choices of blocks of which the rows are on disk at once.
ROUND = 48
#: 32-bit halves are weighed by unpacked bits; this many shingles at a time.
AT_ONCE = 1 << 16


def split_words(data: bytes) -> list[bytes]:
    # bytes.split() takes exactly 0x09-0x0D and 0x20 as white space
    return data.translate(LOWER).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False)))


def fingerprint(data: bytes, n: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    parts = shingles(split_words(data), n)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in parts), dtype="<u8", count=len(parts)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of these hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), AT_ONCE):
        bits = np.unpackbits(h[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], names=["doc_id", "th", "fp"])


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: consecutive numbers, hashed."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], dtype=np.uint64)


def distances(fp: np.ndarray) -> np.ndarray:
    """A row a fingerprint: its distances to the pivots."""
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.uint8)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = distances(batch.column(0).to_numpy().view(np.uint64))
        yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], names=["fp", "far"])


def pairs_within(fp: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are within ``radius``; table: distances to the pivots, a row a pivot."""
    left = np.arange(len(i))
    for row in table:
        left = left[np.abs(row[i[left]] - row[j[left]]) <= radius]
        if not len(left):
            return left
    return left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= radius]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def _linker(radius: int, pairs: bool):
    """Sorted rows (bucket, side, fp, far) to links: within a bucket of side 0, or across sides 1 and 2.

    With ``pairs`` each link is itself a pair within ``radius``, else one of a fingerprint and its component's least.
    """

    def compare(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, node = np.unique(fp, return_inverse=True)
        table = np.ascontiguousarray(np.frombuffer(b"".join(far.tolist()), dtype=np.int8).reshape(len(fp), -1).T)
        ends = np.searchsorted(bucket, bucket, "right")
        found_a, found_b = [], []
        at, step = np.flatnonzero(ends - np.arange(len(fp)) > 1), 1
        root = np.arange(len(values))
        while len(at):
            j = at + step
            ok = (side[at] != side[j]) | (side[at] == 0)
            i, j = at[ok], j[ok]
            hit = pairs_within(fp, i, j, table, radius)
            a, b = node[i[hit]], node[j[hit]]
            if pairs:
                new = root[a] != root[b]
                a, b = a[new], b[new]
                if len(a):
                    root = _forest(len(values), np.concatenate([root, a]), np.concatenate([np.arange(len(values)), b]))
            found_a.append(a)
            found_b.append(b)
            if not pairs and sum(map(len, found_a)) > 1 << 20:  # links are merged as they come, so they take bounded memory
                root = _forest(len(values), np.concatenate([root, *found_a]), np.concatenate([np.arange(len(values)), *found_b]))
                found_a, found_b = [], []
            step += 1
            at = at[at + step < ends[at]]
        if pairs:
            none = [np.zeros(0, dtype=np.int64)]
            return values[np.concatenate(none + found_a)], values[np.concatenate(none + found_b)]
        root = _forest(len(values), np.concatenate([root, *found_a]), np.concatenate([np.arange(len(values)), *found_b]))
        own = np.flatnonzero(root != np.arange(len(values)))
        return values[own], values[root[own]]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def done(cols):
            a, b = compare(*cols)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False))
            kept.append(new)
            rows += len(new[0])
            if rows >= 1 << 17:
                cols = tuple(map(np.concatenate, zip(*kept, strict=True)))
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
                if cut:
                    yield done(tuple(c[:cut] for c in cols))
                kept, rows = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if rows:
            yield done(tuple(map(np.concatenate, zip(*kept, strict=True))))

    return link


def choose_blocks(n: int, radius: int = RADIUS, equal: int = 1) -> tuple[int, int]:
    """(blocks, blocks that must be equal, ``equal`` at least): the least rows written plus pairs compared for n fingerprints."""

    def cost(blocks: int) -> float:
        same = blocks - radius
        tables, bits = comb(blocks, same), 64 * same / blocks
        return tables * n * (50 + n / 2 ** (bits + 1))

    blocks = min(range(radius + equal, radius + 6), key=cost)
    return blocks, blocks - radius


def table_keys(fp: Column, blocks: int, same: int) -> list[Column]:
    """A bucket number for each choice of ``same`` of the ``blocks``."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), same)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return out


def spread(rows: DataFrame, key: str, tables: Tables) -> DataFrame:
    """``rows`` with ``side``: buckets of more than CHUNK rows become pairs of chunks.

    Rows of a bucket meet if both sides are 0 or the sides differ.
    """
    others_of = [c for c in rows.columns if c != "bucket"]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > CHUNK)
    sizes = tables.cut(sizes.select("bucket", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"), "rows"), "hot-buckets")
    if sizes.isEmpty():
        return rows.select("bucket", F.lit(0).alias("side"), *others_of)
    rows = join_unique(rows, sizes, ["bucket"]).withColumn("own", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.xxhash64("bucket", F.least(c, "own"), F.greatest(c, "own")).alias("bucket"), F.when(c == F.col("own"), 0).when(c > F.col("own"), 1).otherwise(2).alias("side")))
    place = F.when(F.col("chunks").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("side")))).otherwise(others)
    return rows.select(F.explode(place).alias("p"), *others_of).select("p.bucket", "p.side", *others_of)


def near_links(spark: SparkSession, prints: DataFrame, tables: Tables, radius: int = RADIUS, pairs: bool = False, equal: int = 1) -> DataFrame:
    """``prints``: distinct fp bigint.  Links (a, b) that connect all pairs within ``radius``; with ``pairs`` all are such."""
    table = tables.cut(prints.select("fp").mapInArrow(_distances, "fp bigint, far binary"), "pivot-table")
    blocks, same = choose_blocks(table.count(), radius, equal)
    keys, out = table_keys(F.col("fp"), blocks, same), []
    # in one order in all buckets, near fingerprints give the same pairs in many of them
    order = ["bucket", "fp"] if pairs else ["bucket"]
    for i in range(0, len(keys), ROUND):
        rows = table.select(F.explode(F.array(*keys[i : i + ROUND])).alias("bucket"), "fp", "far")
        rows = spread(rows, "fp", tables).repartition("bucket").sortWithinPartitions(*order)
        out.append(tables.cut(rows.mapInArrow(_linker(radius, pairs), "a bigint, b bigint"), "near-links"))
    return reduce(DataFrame.union, out)


def pruned(fp: np.ndarray, radius: int = RADIUS) -> tuple[int, int]:
    """Of all pairs of these fingerprints, how many the pivots discard, and how many survive and are no pair."""
    i, j = np.triu_indices(len(fp), 1)
    table = distances(fp).astype(np.int8)
    gone = np.zeros(len(i), dtype=bool)
    for column in table.T:
        gone |= np.abs(column[i] - column[j]) > radius
    return int(gone.sum()), int((~gone & (np.bitwise_count(fp[i] ^ fp[j]) > radius)).sum())


def rooted(spark: SparkSession, docs: DataFrame, tables: Tables, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) of each document, and (fp, root, first, rows) of each fingerprint."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    prints = tables.cut(docs.mapInArrow(_fingerprints, "doc_id bigint, th bigint, fp bigint"), "fingerprints")
    nodes = tables.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "nodes")
    links = near_links(spark, nodes.select("fp"), tables, radius)
    roots = components(spark, links, tables)
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    joined = tables.cut(joined, "rooted")
    for t in (nodes, links, roots):
        tables.drop(t)
    return prints, joined


def report(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    tables = Tables(spark)
    prints, joined = rooted(spark, docs, tables, radius)
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    names = tables.cut(names, "components")
    named = tables.cut(join_unique(joined, names, ["root"], weight="n").select("fp", "component_id", "rows"), "named")
    tables.drop(joined)
    tables.drop(names)
    out = join_unique(prints, named, ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that have the least doc_id of their component, one row a component.

    Of rows with that doc_id the one of least text hash stays, and one of rows that are equal in both.
    """
    tables = Tables(spark)
    prints, joined = rooted(spark, docs, tables, radius)
    placed = join_unique(prints, joined.select("fp", "root", "rows"), ["fp"])
    return least_rows(docs, prints, placed, tables)


def least_rows(docs: DataFrame, prints: DataFrame, placed: DataFrame, tables: Tables) -> DataFrame:
    """One row of ``docs`` for each root of ``placed`` (doc_id, th, root)."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    doc, th = (free_prefix(docs.columns) + k for k in ("doc", "th"))
    kept = placed.groupBy("root").agg(F.min(place).alias("p"))
    kept = tables.cut(kept.select(F.col("p.doc_id").alias(doc), F.col("p.th").alias(th)), "kept")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept[doc]) & (F.xxhash64(docs["text"]) == kept[th]), "left_semi")
    same = prints.groupBy("doc_id", "th").count().filter("count > 1")
    return out if same.isEmpty() else out.dropDuplicates(["doc_id", "text"])
