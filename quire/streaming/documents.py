"""Structured Streaming: the same transforms over documents that arrive, and context kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import text as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CONTEXT = "key string, seq bigint, context string"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, files: int = 16) -> DataFrame:
    """Parquet files of documents as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def transform_batches(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a batch transform on each micro-batch; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_texts(docs: DataFrame, time: str | None = None, within: str = "7 days") -> DataFrame:
    """Documents whose text has not come before; the state is a hash a text.

    With ``time``, a column of timestamps, a hash is forgotten when the watermark is ``within`` past it, so the state is
    bounded by the texts of that span.  Without it the state holds every text's hash, 16 characters each: for streams
    that end.
    """
    hashed = docs.withColumn("hash16", T.chunk_hash(F.col("text")))
    return hashed.dropDuplicates(["hash16"]) if time is None else hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["hash16"])


def language_counts(docs: DataFrame) -> DataFrame:
    """A running count of documents by detected language."""
    return docs.groupBy(T.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


def _remember(paragraphs: int, chars: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, text in zip(rows.seq, rows.text, strict=True):
            picked, left = [], chars
            for old in reversed(held):
                if left <= 0:
                    break
                picked.append(old[-left:].lstrip())
                left -= len(picked[-1])
            out.append((key[0], seq, "\n\n".join(reversed(picked))))
            if clean := " ".join((text or "").split()):
                held = [*held, clean][-paragraphs:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "seq", "context"])

    return step


def keyed_context(rows: DataFrame, paragraphs: int = 3, chars: int = 1200) -> DataFrame:
    """(key, seq, context) for a stream (key string, seq bigint, text string): what the key said last."""
    return rows.groupBy("key").applyInPandasWithState(_remember(paragraphs, chars), CONTEXT, "held array<string>", "append", GroupStateTimeout.NoTimeout)
