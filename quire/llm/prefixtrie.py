"""The trie of conversations' beginnings, family by family and then merged.

A conversation is rebuilt from the first turns of its family's base and its own later ones.  The conversations of a
family (one base id) meet in one group, which rebuilds them and builds the family's small trie; only combined nodes are
shuffled on, and nodes of equal beginnings become one, whatever family they are from.  A node's id is 128 bits: the sum,
in four lanes of 32 bits, of the MD5 of each turn with its place.  Sums of prefixes can be taken apart, so a
conversation above ``LONG`` turns is never in one group: its turns are range-sorted, each range is summed by itself, and
its nodes join the merge one by one.

Leaves and saved tokens below a node are sums over its subtree.  They are added up by pointer jumping: in round k a node
gives its sum to its ancestor 2^k above, so a trie of depth d takes log2(d) rounds, each over the nodes deeper than 2^k.
Nodes that very many have for an ancestor are joined by ``join_unique``.  Ids of conversations that end at one node are
range-sorted and joined to texts of 1 MB at most, which one task takes up in order, so a node may end any number.

Defined results.  Turns go by number, nulls first, then by the MD5 of role and text.  A null role or text is an empty
one.  Rows without a conv_id are of no conversation.  Repeated rows are turns of their own.  An empty table has no
nodes, not even a root.  Texts count in code points, whatever their length.  Only ``conv_id``, ``turn``, ``role`` and
``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import Tables, join_unique

#: Ids of one family, and the most turns that a conversation takes from its base, by contract.
FAMILY, HEAD = 100, 5
#: Turns of a conversation that a family's group takes.
LONG = 4096
#: Characters of ids that are hashed at once.
TEXT = 1 << 20
NODE = "id binary, parent binary, depth bigint, chars bigint, conv_id bigint, n_convs bigint, ends array<bigint>"
ROOT = bytes(16)


def taken_over(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % (HEAD + 1)


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, chars) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    conv_id = F.col("conv_id").cast("bigint")
    return conversations.filter(F.col("conv_id").isNotNull()).select((conv_id - conv_id % FAMILY).alias("base"), conv_id.alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))


def _step(lanes: tuple[int, ...], place: int, digest: bytes) -> tuple[int, ...]:
    term = struct.unpack(">4I", hashlib.md5(b"%d:" % place + digest).digest())
    return tuple((a + b) & 0xFFFFFFFF for a, b in zip(lanes, term, strict=True))


def _family(table: pa.Table) -> pa.Table:
    """The trie of one family.  Rows with ``head`` are the first turns of a base that is too long to be here."""
    table = table.take(pc.sort_indices(table, [("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start"))
    base = table["base"][0].as_py()
    own: dict[int, list] = {}
    heads = []
    for conv_id, digest, chars, head in zip(*(table[c].to_pylist() for c in ("conv_id", "digest", "chars", "head")), strict=True):
        (heads if head else own.setdefault(conv_id, [])).append((digest, chars))
    heads = heads or own.get(base, [])[:HEAD]
    nodes: dict[bytes, list] = {}
    for conv_id, mine in own.items():  # ascending, so the first to come is the smallest member
        h = taken_over(conv_id)
        lanes, node = (0, 0, 0, 0), nodes.setdefault(ROOT, [None, 0, 0, conv_id, 0, []])
        node[4] += 1
        at = ROOT
        for place, (digest, chars) in enumerate(heads[:h] + mine[h:]):
            lanes = _step(lanes, place, digest)
            parent, at = at, struct.pack(">4I", *lanes)
            node = nodes.setdefault(at, [parent, place + 1, chars, conv_id, 0, []])
            node[4] += 1
        node[5].append(conv_id)
    columns = list(zip(*nodes.values(), strict=True)) or [[]] * 6
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.table([pa.array(list(nodes), pa.binary()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["id", "parent", "depth", "chars", "conv_id", "n_convs", "ends"])


def _lanes(term: Column) -> list[Column]:
    return [F.conv(F.substring(term, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _id(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0") for x in lanes]))


def _ranked(spark: SparkSession, rows: DataFrame, tables: Tables) -> DataFrame:
    """Turns of long conversations with their ``place``; each range of the sort counts by itself."""
    ranges = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id())
    stored = tables.cut(ranges, "long-turns")
    sizes = stored.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return tables.cut(stored.join(sizes, ["conv_id", "part"]).withColumn("place", F.col("first") + F.row_number().over(inside) - 1), "long-places")


def _long_nodes(spark: SparkSession, ranked: DataFrame, short: DataFrame, tables: Tables) -> DataFrame:
    """The nodes of long conversations, one for each of their turns."""
    bases = ranked.select("base").distinct()
    of_short = Window.partitionBy("base").orderBy(F.col("turn").asc_nulls_first(), "digest")
    first = short.filter("conv_id = base").join(bases, "base").withColumn("place", (F.row_number().over(of_short) - 1).cast("bigint"))
    heads = ranked.filter("conv_id = base").select("base", "place", "digest", "chars").union(first.select("base", "place", "digest", "chars")).filter(F.col("place") < HEAD)
    heads = tables.cut(heads, "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).alias("h")
    convs = ranked.groupBy("conv_id", "base").agg(F.count("*").alias("n")).select("*", h)
    convs = convs.join(heads.groupBy("base").agg(F.count("*").alias("n_heads")), "base", "left").withColumn("used", F.least("h", F.coalesce("n_heads", F.lit(0)))).select("conv_id", "base", "h", "used", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("used")).alias("length"))
    convs = tables.cut(convs, "long-convs")  # one for every LONG turns at most
    own = join_unique(ranked.select("conv_id", "part", "place", "digest", "chars"), convs.select("conv_id", "h", "used", "length", (F.col("length") + F.col("h")).alias("rows")), ["conv_id"], "inner")
    own = own.filter("place >= h").select("conv_id", "part", (F.col("place") - F.col("h") + F.col("used")).alias("place"), "digest", "chars", "length")
    begun = convs.join(heads, "base").filter("place < used").select("conv_id", F.lit(-1).alias("part"), "place", "digest", "chars", "length")
    whole = own.union(begun)
    term = F.md5(F.concat(F.concat(F.col("place").cast("string"), F.lit(":")).cast("binary"), F.col("digest")))
    whole = tables.cut(whole.withColumn("terms", F.array(*_lanes(term))), "long-terms")
    sums = whole.groupBy("conv_id", "part").agg(*[F.sum(F.col("terms")[i]).alias(f"s{i}") for i in range(4)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *[F.coalesce(F.sum(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    inside = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ran = whole.join(sums, ["conv_id", "part"]).withColumns({f"t{i}": F.col(f"b{i}") + F.sum(F.col("terms")[i]).over(inside) for i in range(4)})
    ends = F.when(F.col("place") + 1 == F.col("length"), F.array("conv_id")).otherwise(F.array().cast("array<bigint>"))
    parent = _id([F.col(f"t{i}") - F.col("terms")[i] for i in range(4)])
    nodes = ran.select(_id([F.col(f"t{i}") for i in range(4)]).alias("id"), parent.alias("parent"), (F.col("place") + 1).alias("depth"), "chars", "conv_id", F.lit(1).cast("bigint").alias("n_convs"), ends.alias("ends"))
    zero, alone = F.lit(0).cast("bigint"), F.when(F.col("length") == 0, F.array("conv_id")).otherwise(F.array().cast("array<bigint>"))
    roots = convs.select(F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("chars"), "conv_id", F.lit(1).cast("bigint").alias("n_convs"), alone.alias("ends"))
    return nodes.union(roots)


def family_nodes(spark: SparkSession, conversations: DataFrame, tables: Tables, long: int = LONG) -> DataFrame:
    """A stored table of the nodes of every family's trie: members, and ids that end there, are the family's own."""
    rows = turns(conversations)
    lengthy = tables.cut(rows.groupBy("conv_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > long), "long")
    none = F.lit(None).cast("boolean").alias("head")
    if lengthy.isEmpty():
        return tables.cut(rows.select("*", none).groupBy("base").applyInArrow(_family, NODE), "family-nodes")
    told = tables.cut(join_unique(rows, lengthy.withColumn("lengthy", F.lit(True)), ["conv_id"]), "turns")
    short = told.filter("lengthy IS NULL").drop("lengthy")
    ranked = _ranked(spark, told.filter("lengthy").drop("lengthy"), tables)
    # the place among the first turns stands for their order
    heads = ranked.filter((F.col("conv_id") == F.col("base")) & (F.col("place") < HEAD)).select("base", "conv_id", F.col("place").alias("turn"), "digest", "chars", F.lit(True).alias("head"))
    family = short.select("*", none).union(heads).groupBy("base").applyInArrow(_family, NODE)
    return tables.cut(family.union(_long_nodes(spark, ranked, short, tables)), "family-nodes")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id and conv_id: runs of equal ids as texts of about TEXT characters."""
    at, first, held, size = None, None, [], 0
    for batch in batches:
        out = []
        for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (node != at or size >= TEXT):
                out.append((at, first, ",".join(held)))
                held, size = [], 0
            if not held:
                at, first = node, conv_id
            held.append(str(conv_id))
            size += len(held[-1])
        yield _text_rows(out)
    if held:
        yield _text_rows([(at, first, ",".join(held))])


def _text_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["id", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each id's texts, which come in order."""
    at, sha = None, None
    names, types = ["id", "ends_sha256"], (pa.binary(), pa.string())
    for batch in batches:
        out = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == at:
                sha.update(b"," + text.encode())
                continue
            if sha is not None:
                out.append((at, sha.hexdigest()))
            at, sha = node, hashlib.sha256(text.encode())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[], []], types, strict=True)], names=names)
    if sha is not None:
        yield pa.record_batch([pa.array([at], types[0]), pa.array([sha.hexdigest()], types[1])], names=names)


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations end."""
    ends = nodes.select("id", F.explode("ends").alias("conv_id"))
    texts = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_texts, "id binary, first bigint, text string")
    return texts.repartition("id").sortWithinPartitions("id", "first").select("id", "text").mapInArrow(_digests, "id binary, ends_sha256 string")


def subtree_sums(tree: DataFrame, values: list[str], tables: Tables) -> DataFrame:
    """(id, values): of each node of ``tree`` (id, parent, depth, values), the sums over its subtree."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    parts = [tree.select("id", *values)]
    live, step = tree.filter("depth >= 1").select("id", "depth", F.col("parent").alias("above"), *values), 1
    while step <= deepest:
        given = tables.cut(live.groupBy("above").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("rows")), f"given-{step}")
        parts.append(given.select(F.col("above").alias("id"), *values))
        if 2 * step > deepest:
            break
        add = given.select(F.col("above").alias("id"), *[F.col(v).alias(f"{v}_below") for v in values], "rows")
        have = live.join(add, "id", "left").select("id", "depth", "above", *[(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values], F.coalesce("rows", F.lit(0)).alias("rows"))
        have = tables.cut(have, f"have-{step}")
        higher = have.filter("rows > 0").select(F.col("id").alias("above"), F.col("above").alias("higher"), "rows")
        lower = have.filter(F.col("depth") >= 2 * step).drop("rows")
        live = tables.cut(join_unique(lower, higher, ["above"]).select("id", "depth", F.col("higher").alias("above"), *values), f"live-{step}")
        step *= 2
    return reduce(DataFrame.union, parts).groupBy("id").agg(*[F.sum(v).alias(v) for v in values])


def trie(spark: SparkSession, conversations: DataFrame, tables: Tables, long: int = LONG) -> DataFrame:
    """A row for each node: id, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    families = family_nodes(spark, conversations, tables, long)
    merged = families.groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = tables.cut(merged, "nodes")
    children = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = merged.join(children, "id", "left").select("id", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    tree = tables.cut(tree.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")), "tree")
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"], tables)
    parents = tree.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    named = join_unique(tree.drop("n_leaves", "saved_tokens"), parents, ["parent"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = named.join(sums, "id").join(ends_digests(families), "id", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    out = trie(spark, conversations, Tables(spark))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
