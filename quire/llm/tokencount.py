"""Token counts of flat, unindexed token files by a separator scan.

``write_token_files`` encodes documents and writes each one's ids as little-endian bytes, with the end-of-document
id as Spark's line separator, so the files are nothing but ids; a file holds about FILE_BYTES.  ``scan`` reads files in
blocks: NumPy finds the separators of a block, and a prefix scan over one small row a block carries the tokens before
each block, the documents before it and the last separator before it, which closes documents that run across blocks.
The blocks' separators stay in the tasks that found them and only meet those numbers.

Defined results.  A null or empty text is a document of no tokens; one of any length is one document.  Tokens behind a
file's last separator are one more document, which is not ``closed``.  Repeated rows are documents of their own.  An
empty table or file has no documents.  Only ``text`` is read; other columns may have any names.  A file is read as one
value, which Java bounds at 2 GB: longer ones are refused by the reader.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import Tables, shared_path

#: Ids of a block, and bytes of text whose ids make a file.
BLOCK, FILE_BYTES = 1 << 19, 64 << 20
BLOCK_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
#: The vocabulary's split pattern and free id; fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: A vocabulary file is sent to the executors; it is refused above this size.
MOST_VOCABULARY = 64 << 20
#: A file is no longer than this, whatever its documents are.
MOST_BYTES = 1_900_000_000


@lru_cache(1)
def _encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(vocabulary, width: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary.value)
        for batch in batches:
            out = [np.array(encoding.encode_ordinary(t or ""), dtype=f"<u{width}").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["ids"])

    return encode


def write_token_files(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = 2) -> str:
    """Writes flat token files, ids of ``width`` bytes; returns their folder."""
    with open(vocabulary, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError("the vocabulary file is too large to send to the executors")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    n, total, most = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    records = max(1, min(FILE_BYTES // (total // max(1, n) + 1), MOST_BYTES // (width * (most + 1))))  # an id is a byte of text at least
    path = shared_path(spark, "tokens")
    ids = docs.select("text").mapInArrow(_encoder(spark.sparkContext.broadcast(data), width), "ids binary")
    separator = end.to_bytes(width, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(path)
    return path


def _separators(end: int, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for block in batch.column(2):
                ids = np.frombuffer(block.as_buffer() or b"", dtype=f"<u{width}")
                n.append(len(ids))
                found.append(np.flatnonzero(ids == end).astype(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return find


def scan(spark: SparkSession, path: str, tables: Tables, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) of each document in the token files of a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    step = block * width
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step)))).alias("block"), "content")
    blocks = blocks.select("path", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("ids"))
    found = tables.cut(blocks.mapInArrow(_separators(end, width), "file string, block bigint, n bigint, ends array<bigint>"), "separators", BLOCK_ROWS)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = found.select("file", "block", "n", F.size("ends").alias("count"), F.try_element_at("ends", F.lit(-1)).alias("end"))
    sums = sums.withColumns({"base": F.coalesce(F.sum("n").over(before), none), "docs": F.coalesce(F.sum("count").over(before), none), "is_last": F.lead("block").over(order).isNull()})
    sums = sums.withColumn("last", F.coalesce(F.max(F.col("base") + F.col("end")).over(before), F.lit(-1).cast("long")))
    sums = tables.cut(sums.select("file", "block", "base", "docs", "last", "is_last"), "prefix-sums")
    found = found.join(sums, ["file", "block"])
    last = F.col("base") + F.try_element_at("ends", F.lit(-1))
    open_end = F.col("is_last") & (F.coalesce(last, F.col("last")) < F.col("base") + F.col("n") - 1)
    ends = F.when(open_end, F.concat("ends", F.array("n"))).otherwise(F.col("ends"))
    rows = found.select("file", "base", "docs", "last", "n", ends.alias("ends"))
    rows = rows.select("*", F.posexplode("ends").alias("i", "p"))
    start = F.when(F.col("i") == 0, F.col("last")).otherwise(F.col("base") + F.try_element_at("ends", F.col("i"))) + 1
    name = F.regexp_extract("file", r"[^/]*$", 0)
    return rows.select(name.alias("file"), (F.col("docs") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("p") - start).alias("n_tokens"), (F.col("p") < F.col("n")).alias("closed"))


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the token files of ``docs`` and scans them; ``file`` is the part number."""
    tables = Tables(spark)
    out = scan(spark, write_token_files(spark, docs, vocabulary), tables)
    return out.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
