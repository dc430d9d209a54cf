"""Ordered operators: sliding context, sessions, numbering, ranking, cache and resume plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

CONTEXT_ROWS, CONTEXT_CHARS = 3, 1200


def recent_context(rows: DataFrame, part: str, order: str, n: int = CONTEXT_ROWS, chars: int = CONTEXT_CHARS) -> DataFrame:
    """``rows`` with context: the last ``n`` texts before a row, within ``chars`` characters; the oldest is cut."""
    before = Window.partitionBy(part).orderBy(order).rowsBetween(-n, -1)
    texts = F.filter(F.transform(F.collect_list("text").over(before), T.squeeze), lambda x: x != "")
    start = F.struct(F.lit(chars).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        cut = F.when(F.length(x) > s.left, F.ltrim(F.right(x, s.left))).otherwise(x)
        return F.when(s.left <= 0, s).otherwise(F.struct((s.left - F.length(cut)).alias("left"), F.concat(F.array(cut), s.out).alias("out")))

    picked = F.aggregate(F.reverse(texts), start, step, lambda s: s.out)
    return rows.withColumn("context", F.array_join(picked, "\n\n"))


def context_sessions(rows: DataFrame, part: str, order: str, starts) -> DataFrame:
    """``rows`` with session: a new one begins at each row where ``starts`` holds."""
    w = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("bigint"))


def block_index(rows: DataFrame, part: str, *order: str) -> DataFrame:
    return rows.withColumn("block_idx", F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("bigint"))


def bench_rank(runs: DataFrame) -> DataFrame:
    """Runs that ended well, best score first, then the fastest."""
    order = Window.orderBy(F.col("score").desc(), "total_elapsed")
    return runs.filter("status = 'ok'").withColumn("rank", F.rank().over(order).cast("bigint"))


def latest_cache(entries: DataFrame) -> DataFrame:
    """The newest entry of each (mode, hash)."""
    w = Window.partitionBy("mode", "hash").orderBy(F.col("ts").desc())
    return entries.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def cache_plan(chunks: DataFrame, entries: DataFrame, signature: str) -> DataFrame:
    """``chunks`` (doc_id, chunk_idx, text) with hit: an entry of the same text and signature exists."""
    cache = latest_cache(entries).filter(F.col("signature").eqNullSafe(signature)).select("hash", "final_output")
    rows = chunks.withColumn("hash", T.chunk_hash(F.col("text")))
    return rows.join(cache, "hash", "left").select("doc_id", "chunk_idx", "hash", F.col("final_output").isNotNull().alias("hit"))


def resume_plan(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """``chunks`` with done: the progress of the same place holds the same text and an output."""
    rows = chunks.withColumn("chunk_hash", T.chunk_hash(F.col("text"))).select("doc_id", "chunk_idx", "chunk_hash")
    done = progress.filter("status = 'translated' and output is not null").select("doc_id", "chunk_idx", "chunk_hash", F.lit(True).alias("d"))
    return rows.join(done, ["doc_id", "chunk_idx", "chunk_hash"], "left").select("doc_id", "chunk_idx", "chunk_hash", F.coalesce("d", F.lit(False)).alias("done"))
