"""Near copies by the similarity of their five-word shingles, for the pipeline: exact, no pair is left to chance.

A document is the set of its shingles' XXH64; documents of equal sets are one node.  Two nodes are linked if their
Jaccard similarity is at least 4/5.

First ``simhash`` finds them: a node's fingerprint is that of its set, fingerprints within RADIUS bits are found with
the stored pivot distance table, and those pairs are verified on their whole sets.  Of the
neighbours by which the search connects a node NEAREST are verified; that and RADIUS bound the work and cut no result, for the rest is found another way.

The rest are similar pairs that fingerprints leave in two components: the similarity sets no limit to the bits in
which fingerprints differ.  All sets are put in one order; two that are so similar share one of the first
``n - ceil(4n/5) + 1`` shingles, so nodes meet by these alone (prefix filter), and there only if their sizes and
places allow the similarity; pairs that are in one component by then are not verified.  Shingles that are frequent
in a sample come last in the order: that keeps buckets small and changes no result.  Pairs that meet are verified on
their whole sets.

A bucket of more than SMALL nodes is first linked with CENTRES of its nodes, those that have the fewest rarer shingles:
of a group of copies they are nearest to what was copied.  Then its nodes meet pairwise, in pairs of chunks
(``simhash.spread``), but only pairs that are not yet in one component and whose odd sketches (a bit a cell, flipped by
each shingle in it) allow the similarity become rows: two sketches differ in no more bits than the sets differ in
shingles, so that bound loses no pair, and few pass it that are not similar.

A document's shingles are made once: its fingerprint, its size and its first shingles are written, and one row a node
is kept of them, so that a text costs the search the same whether it is there once or a million times.

Defined results.  Texts without words, null ones among them, are one group.  Fewer words than a shingle make one
shingle.  Of rows that tie in doc_id the one of least text hash stays, of rows that are equal in both one; a null doc_id
comes after all others.  Very long texts are whole sets like others.  Columns besides doc_id and text pass through,
whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.shared import Tables, components, join_spread, join_unique

SHINGLE = 5
#: Bits in which fingerprints of a pair may differ, and how many such neighbours a node is verified with.
RADIUS = 8
NEAREST = 4
#: Blocks in which they must be equal, at least: a fingerprint has as many rows in small tables as in those of 2M.
EQUAL = 2
#: Documents of which the frequent shingles are counted, and how many of these are put last.
SAMPLE = 20_000
FREQUENT = 100_000
SMALL = 64
CENTRES = 4
#: Bits of an odd sketch.
SKETCH = 1024
ROWS = 1 << 17
#: Texts or sets that a Python worker gets at a time: so many bytes, however many rows these are.
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
PRINTS = "doc_id bigint, th bigint, fp bigint, sim bigint, n int, firsts array<bigint>"


def shingle_set(data: bytes) -> np.ndarray:
    parts = simhash.shingles(simhash.split_words(data), SHINGLE)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, simhash.SEED) for s in parts), dtype="<u8", count=len(parts)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(grams: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles by one of which a set meets all sets that are similar; those of the sorted ``late`` come last."""
    n = len(grams)
    if len(late):
        at = np.minimum(np.searchsorted(late, grams), len(late) - 1)
        is_late = late[at] == grams
        grams = np.concatenate([grams[~is_late], grams[is_late]])
    return grams[: n - -(-4 * n // 5) + 1]


def odd_sketch(grams: np.ndarray) -> bytes:
    odd = np.bincount((grams % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _each_set(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    return (shingle_set(t.as_py() or b"") for t in batch.column(column).cast(pa.binary()))


def _printer(late):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for s in _each_set(batch, 1):
                made.append((node_of(s), simhash.majority(s), len(s), prefix(s, late.value) if len(s) else s))
            fp, sim, n, firsts = zip(*made, strict=True) if made else ((), (), (), ())
            ends = np.cumsum([0] + [len(f) for f in firsts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([np.zeros(0, dtype=np.uint64), *firsts])))
            yield pa.record_batch([batch.column(0), batch.column(2), _signed(fp), _signed(sim), pa.array(n, pa.int32()), lists], names=["doc_id", "th", "fp", "sim", "n", "firsts"])

    return prints


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _each_set(batch, 0):
            yield pa.record_batch([pa.array(s.view(np.int64))], names=["gram"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in _each_set(batch, 1)], pa.binary())], names=["node", "grams"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([odd_sketch(s) for s in _each_set(batch, 1)], pa.binary())], names=["node", "sketch"])


def _may(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can be similar: overlap of 4/9 of both sizes."""
    left = np.minimum(n[i] - pos[i], n[j] - pos[j]).astype(np.int64)
    return 9 * left >= 4 * (n[i].astype(np.int64) + n[j])


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows, about ROWS at a time, no bucket cut."""
    kept, rows = [], 0
    for batch in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= ROWS:
            cols = list(map(np.concatenate, zip(*kept, strict=True)))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
            if cut:
                yield tuple(c[:cut] for c in cols)
            kept, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if rows:
        yield tuple(map(np.concatenate, zip(*kept, strict=True)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, node, pos), sorted, to pairs (a, b); large buckets to pairs with centres and their number."""

    def rows(a, b, large):
        none = lambda k: pa.nulls(k, pa.int64())
        cols = [(pa.array(a), pa.array(b), none(len(a))), (none(len(large)), none(len(large)), pa.array(large))]
        return pa.record_batch([pa.concat_arrays([x, y]) for x, y in zip(*cols, strict=True)], names=["a", "b", "large"])

    for bucket, n, node, pos in _whole_buckets(batches):
        ends = np.searchsorted(bucket, bucket, "right")
        starts = np.searchsorted(bucket, bucket, "left")
        large = np.unique(starts[ends - starts > SMALL])
        for s in large:
            members = np.arange(s, ends[s])
            for c in members[np.lexsort((node[members], pos[members]))[:CENTRES]]:
                j = members[(members != c) & _may(n, pos, np.full(len(members), c), members)]
                yield rows(np.full(len(j), node[c]), node[j], np.zeros(0, dtype=np.int64))
        yield rows(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), bucket[large])
        at, step = np.flatnonzero((ends - np.arange(len(node)) > 1) & (ends - starts <= SMALL)), 1
        while len(at):
            j = at + step
            hit = _may(n, pos, at, j)
            yield rows(node[at[hit]], node[j[hit]], np.zeros(0, dtype=np.int64))
            step += 1
            at = at[at + step < ends[at]]


def _differ(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of the pairs differ."""
    out = np.zeros(len(i), dtype=np.int64)
    for w in words.T:
        out += np.bitwise_count(w[i] ^ w[j])
    return out


def _meet_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, side, node, pos, root, sketch), sorted, to the pairs (a, b) that may be similar and are not in one component."""
    for bucket, n, side, node, pos, root, sketch in _whole_buckets(batches):
        words = np.frombuffer(b"".join(sketch.tolist()), dtype="<u8").reshape(len(node), -1)
        ends = np.searchsorted(bucket, bucket, "right")
        at, step = np.flatnonzero(ends - np.arange(len(node)) > 1), 1
        while len(at):
            j = at + step
            fits = 4 * n[j].astype(np.int64) <= 5 * n[at].astype(np.int64)  # sizes rise: later ones don't fit either
            at, j = at[fits], j[fits]
            hit = np.flatnonzero((root[at] != root[j]) & ((side[at] != side[j]) | (side[at] == 0)) & _may(n, pos, at, j))
            hit = hit[9 * _differ(words, at[hit], j[hit]) <= n[at[hit]].astype(np.int64) + n[j[hit]]]
            if len(hit):
                yield pa.record_batch([pa.array(node[at[hit]]), pa.array(node[j[hit]])], names=["a", "b"])
            step += 1
            at = at[at + step < ends[at]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ((np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")) for x, y in zip(batch.column(2), batch.column(3), strict=True))
        ok = pa.array([similar(x, y) for x, y in sets], pa.bool_())
        yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(ok)


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that at least three documents of a sample hold, the most frequent first where they are too many."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("th"), F.lit(every)) == 0).select("text").mapInArrow(_grams, "gram bigint")
    some = some.groupBy("gram").count().filter("count >= 3").orderBy(F.desc("count"), "gram").limit(FREQUENT)
    return np.sort(np.array([r[0] for r in some.collect()], dtype=np.int64).view(np.uint64))


def of_nodes(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, make, column: str) -> DataFrame:
    """(node, column) of the nodes whose fp is in ``wanted``."""
    chosen = nodes.join(wanted, "fp", "left_semi").select("fp", F.col("th").alias("h"), F.col("first").alias("d"))
    # of equal texts one document is named, so many copies of a text do not meet in one task
    texts = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["d"]) & (docs["th"] == chosen["h"])).dropDuplicates(["doc_id", "th"]).select("fp", "text")
    return texts.mapInArrow(make, f"node bigint, {column} binary")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, tables: Tables, roots: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar; with ``roots`` (node, root) those alone that are not yet in one component."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if roots is not None:
        of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        pairs = pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    pairs = tables.cut(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sets = tables.cut(of_nodes(docs, nodes, wanted, _sets, "grams"), "near-sets", BOUNDED)
    side = lambda k, name: sets.select(F.col("node").alias(k), F.col("grams").alias(name))
    # a hub's set has several rows where it has many pairs, and no task gets them all
    both = join_spread(join_spread(pairs, side("a", "x"), "a"), side("b", "y"), "b", pairs).select("a", "b", "x", "y")
    out = tables.cut(both.mapInArrow(_verify, "a bigint, b bigint"), "near-links", BOUNDED)
    tables.drop(pairs)
    tables.drop(sets)
    return out


def print_pairs(spark: SparkSession, nodes: DataFrame, tables: Tables) -> DataFrame:
    """Pairs (a, b) of nodes of near fingerprints: NEAREST lesser ones to each; of equal fingerprints, each with one node."""
    heads = nodes.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("rows"))
    heads = tables.cut(heads, "near-heads")
    links = simhash.near_links(spark, heads.select(F.col("sim").alias("fp")), tables, RADIUS, pairs=True, equal=EQUAL)
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), bits.alias("bits")).distinct()
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))).filter(F.col("rank") <= NEAREST)
    near = tables.cut(near.select("a", "b"), "near-nearest")
    side = lambda k, name: heads.select(F.col("sim").alias(k), F.col("head").alias(name))
    near = join_spread(near, side("b", "y"), "b").join(side("a", "x"), "a").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = join_unique(nodes.select("fp", "sim"), heads, ["sim"]).filter("fp <> head")
    return near.union(equal.select(F.col("fp").alias("a"), F.col("head").alias("b")))


def linked(spark: SparkSession, docs: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of the nodes that are linked with others; ``docs``: doc_id, th, text; ``nodes``: fp, th, first, sim, n, firsts."""
    links = verified(docs, nodes, print_pairs(spark, nodes, tables), tables)
    return rest(spark, docs, nodes, links, tables)


def rest(spark: SparkSession, docs: DataFrame, nodes: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """``linked`` by ``links`` (a, b) and all similar pairs that they leave in two components."""
    places = nodes.select(F.posexplode("firsts").alias("pos", "bucket"), F.col("fp").alias("node"), "n")
    rows = places.repartition("bucket").sortWithinPartitions("bucket", "n", "node").select("bucket", "n", "node", "pos")
    met = tables.cut(rows.mapInArrow(_meet, "a bigint, b bigint, large bigint"), "near-met")
    pairs = met.filter("a is not null").select("a", "b")
    links = links.union(verified(docs, nodes, pairs, tables, components(spark, links, tables)))
    roots = components(spark, links, tables)
    large = met.filter("large is not null").select(F.col("large").alias("bucket"))
    if not large.isEmpty():
        rest = places.join(large, "bucket", "left_semi").join(roots, "node", "left")
        rest = tables.cut(rest.select("bucket", "n", "node", "pos", F.coalesce("root", "node").alias("root")), "near-rest")
        mixed = rest.groupBy("bucket").agg(F.min("root").alias("l"), F.max("root").alias("h")).filter("l <> h").select("bucket")
        rest = tables.cut(rest.join(mixed, "bucket", "left_semi"), "near-mixed")
        sketches = tables.cut(of_nodes(docs, nodes, rest.select(F.col("node").alias("fp")).distinct(), _sketches, "sketch"), "near-sketches")
        rest = simhash.spread(rest.join(sketches, "node"), "node", tables)
        rest = rest.select("bucket", "n", "side", "node", "pos", "root", "sketch").repartition("bucket").sortWithinPartitions("bucket", "n", "node")
        more = verified(docs, nodes, rest.mapInArrow(_meet_apart, "a bigint, b bigint"), tables)
        tables.drop(sketches)
        roots = components(spark, links.union(more), tables)
    return roots


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the least doc_id of their group, one row a group, as in ``simhash``."""
    tables = Tables(spark)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    late = spark.sparkContext.broadcast(frequent(texts))
    made = tables.cut(texts.mapInArrow(_printer(late), PRINTS), "near-made", BOUNDED)
    prints = tables.cut(made.select("doc_id", "th", "fp"), "near-prints")
    # one row a node: of equal sets, that of one text and document
    named = F.min(F.struct("th", "doc_id")).alias("named")
    nodes = made.groupBy("fp").agg(named, F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("sim", "n", "firsts")])
    nodes = tables.cut(nodes.select("fp", "named.th", F.col("named.doc_id").alias("first"), "rows", "sim", "n", "firsts"), "near-nodes")
    tables.drop(made)
    roots = linked(spark, texts, nodes, tables)
    joined = tables.cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rows"), "near-rooted")
    return simhash.least_rows(docs, prints, join_unique(prints, joined, ["fp"]), tables)
