"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the running sum of a source's buckets shows the bucket in which its
budget ends, and only that bucket is split again, by the hash's next bits, until it holds a single hash value.
The mix is then a filter ``hash <= threshold``: nothing is sorted, and a smaller budget takes a subset of what a
larger one takes.  DataFrame functions only.

Defined results.  A null or empty text has no words and is never taken.  A null source is one source, the last.
Rows equal in doc_id and text share a hash and are taken or left together; the choice comes nearer the target, and
where both are as near they are left.  A text of any length counts whole.  An empty table gives no rows.  Columns of
any names pass through ``mix``.  The targets are set over one row a source, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import Tables, free_prefix

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that are used, and how many each pass looks at.
HASH_BITS, STEP = 60, 12
#: More sources than this and the plan table is joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.xxhash64(text)), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the level at which the capped shares fill up."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rows = rows.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.when(F.col("free"), F.least(level * F.col("w"), "cap")).otherwise(F.col("cap")).alias("target"))


def plan(spark: SparkSession, base: DataFrame, weights: Sequence[float], most: float, tables: Tables) -> DataFrame:
    """(source, size, h) rows to one row a source: source_size, target, repeats, threshold."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plans = source_targets(sizes, weights, most)
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    plans = plans.withColumn("repeats", repeats).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    # taken: words of the buckets below the open one; prefix: the open bucket; done: the open bucket is one hash value
    plans = plans.select("*", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"), (F.col("rest") <= 0).alias("done"), F.lit(-1).cast("long").alias("threshold"))
    plans = tables.cut(plans, "mix-plan")
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        wide = _small(plans.filter(~F.col("done")).select(F.col("source").alias("s"), "prefix", "below", "rest"), plans)
        rows = base.join(wide, base.source.eqNullSafe(wide.s) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        hist = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("below").alias("below"), F.first("rest").alias("rest"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.col("below") + F.sum("words").over(run))
        opened = hist.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        opened = opened.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("upto") - F.col("words")).alias("o_below"), "words", "lo", "hi")
        one = F.col("lo") == F.col("hi")
        nearer = 2 * (F.col("rest") - F.col("o_below")) > F.col("words")
        new = plans.join(opened, plans.source.eqNullSafe(opened.s), "left")
        here = F.col("b").isNotNull()
        new = new.select(
            "source", "source_size", "target", "repeats", "rest",
            F.when(here, F.col("o_below")).otherwise(F.col("below")).alias("below"),
            F.when(here, F.col("b")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(here, one).otherwise(F.lit(True)).alias("done"),
            # the threshold is the largest hash taken
            F.when(here & one, F.when(nearer, F.col("hi")).otherwise(F.col("lo") - 1))
            .when(here, F.col("threshold"))
            .when(~F.col("done"), F.lit((1 << HASH_BITS) - 1))  # the budget ends above every bucket
            .otherwise(F.col("threshold")).alias("threshold"),
        )
        new = tables.cut(new, "mix-plan")
        tables.drop(plans)
        plans = new
        if plans.filter(~F.col("done")).isEmpty():
            break
    return plans.select("source", "source_size", "target", "repeats", "threshold")


def _small(df: DataFrame, counted: DataFrame) -> DataFrame:
    return F.broadcast(df) if counted.count() <= BROADCAST_SOURCES else df


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """``docs`` with size, source_size, target and taken, the words that the mix takes of each row, behind ``free_prefix``."""
    tables = Tables(spark)
    size, h = word_count(F.col("text")), mix_hash(F.col("doc_id"), F.col("text"))
    base = tables.cut(docs.select("source", size.alias("size"), h.alias("h")), "mix-base")
    plans = plan(spark, base, weights, most, tables)
    tables.drop(base)
    return apply_plan(docs, size, h, plans)


def apply_plan(docs: DataFrame, size: Column, h: Column, plans: DataFrame) -> DataFrame:
    own = free_prefix(docs.columns)
    p = _small(plans.select(*[F.col(c).alias(own + c) for c in ("source", "source_size", "target", "repeats", "threshold")]), plans)
    rows = docs.withColumns({own + "size": size, own + "h": h})
    rows = rows.join(p, rows["source"].eqNullSafe(p[own + "source"]))
    copies = F.col(own + "repeats") + F.when(F.col(own + "h") <= F.col(own + "threshold"), 1).otherwise(0)
    return rows.withColumn(own + "taken", (F.col(own + "size") * copies).cast("long")).drop(own + "source", own + "h", own + "repeats", own + "threshold")


def mix_report(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; the words are counted once."""
    tables = Tables(spark)
    size, h = word_count(F.col("text")), mix_hash(F.col("doc_id"), F.col("text"))
    base = tables.cut(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "mix-base")
    plans = plan(spark, base.select("source", "size", "h"), weights, most, tables)
    rows = apply_plan(base, F.col("size"), F.col("h"), plans)
    own = free_prefix(base.columns)
    return rows.select("doc_id", *[F.col(own + c).alias(c) for c in ("size", "source_size", "target", "taken")])
