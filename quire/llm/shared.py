"""Helpers that the pipeline operators share: durable intermediate tables, skew-proof joins, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session of one machine that names no shared folder, as in tests.
DEFAULT_ROOT = "file:///tmp/checkpoints/quire"
#: A key that holds more than 1/HOT of all rows is hot; so at most HOT keys are.
HOT = 1000
#: Rows of one key that a task takes in any case.
FEW = 256
#: Set while intermediate tables are written: their shuffle files go as soon as the table is there.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT_ROOT
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted at the end of ``released``, or else of the application."""
    path = f"{shared_root(spark)}/quire-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    for made in _OPEN:
        made.append(path)
    return path


#: The paths made inside each ``released`` block that is open.
_OPEN: list[list[str]] = []


@contextmanager
def released(spark: SparkSession):
    """Deletes at its end what operators have written inside it: read their results before."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        del _OPEN[next(i for i, m in enumerate(_OPEN) if m is made)]
        for path in made:
            delete(spark, path)


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column's name has, for columns that an operator adds."""
    out = "_quire"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out + "_"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Tables:
    """Intermediate tables in the shared folder.

    ``cut`` writes a DataFrame as Parquet and reads it back: lineage ends there, any executor can read the
    files, and a lost executor costs a task and not the table.  ``drop`` deletes a table that is read no more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # the DataFrame is held, so its id stays its own

    def cut(self, df: DataFrame, name: str = "", conf: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
        path = path or shared_path(self.spark, name)
        with settings(self.spark, WRITING | (conf or {})):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        if found := self.paths.pop(id(df), None):
            delete(self.spark, found[1])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", weight: str = "rows") -> DataFrame:
    """Joins ``left`` with ``right``, which has one row a key and the number of ``left`` rows in ``weight``.

    Keys that hold more than 1/HOT of all rows, HOT at most, are broadcast and their rows are not shuffled; the
    others are joined by a shuffle, in which no key is hot.  ``right`` is read twice: give a table.
    """
    extra = [c for c in right.columns if c not in keys and c != weight]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * F.lit(HOT) > F.lit(total)
    struct = F.struct(F.lit(True).alias("found"), *[F.col(c) for c in extra])
    hot = right.filter(is_hot).select(*keys, struct.alias("_hot"))
    cold = right.filter(~is_hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], struct.alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    out = left.join(F.broadcast(hot), keys, "left")
    # rows of hot keys lose their key, match nothing and are dealt out by the hash of the row
    free = F.col("_hot").isNull()
    on = [F.when(free, F.col(k)) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    on.append(F.when(free, F.lit(0).cast("long")).otherwise(F.xxhash64(*left.columns)) == F.col("_salt"))
    out = out.join(cold, on, "left")
    both = F.coalesce("_hot", "_cold")
    cols = [F.col(c) for c in left.columns] + [both[c].alias(c) for c in extra]
    if how == "inner":
        out = out.filter(both.isNotNull())
    return out.select(*cols)


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key, of any width: nothing of ``right`` is broadcast.

    Rows of a key that holds more than 1/HOT of ``left`` are dealt to copies of its row, so that no task gets more of
    them; there are 2 HOT copies at most.  Rows are counted, and dealt by the columns, in ``rows``, a table: by default
    ``left``, else that of which ``left`` is made.
    """
    rows = left if rows is None else rows
    share = max(rows.count() // HOT, FEW)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > share)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / share).alias("_shards")))
    shards = F.coalesce("_shards", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), shards)).drop("_shards")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))).drop("_shards")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(spark: SparkSession, links: DataFrame, tables: Tables) -> DataFrame:
    """Connected components of ``links`` (a bigint, b bigint): (node, root), root the least node reachable.

    Alternating large-star and small-star steps: the least neighbours come by partial minima, and links meet them by
    ``join_unique``, so the links of a hub stay where they are: no task holds more than 1/HOT of them by one node.
    Counts of rows alone come to the driver.
    """
    sides = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    edges = tables.cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: each neighbour above u is linked with the least of u and its neighbours
        both = sides(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        least = tables.cut(least, "least")
        large = join_unique(both.filter("v > u"), least, ["u"], how="inner").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = tables.cut(large, "large")
        # small star: each neighbour below u, and u, are linked with the least of them
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        down = tables.cut(down, "down")
        small = join_unique(large.withColumnRenamed("a", "u"), down, ["u"], how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = tables.cut(small.filter("a <> b").distinct(), "links")
        same = edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty()
        for t in (edges, least, large, down):
            tables.drop(t)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
