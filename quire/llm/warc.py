"""WARC archives: writing records, and reading them back by boundary-chain verification.

``write_archives`` lays records out as text rows that end in the record separator, so Spark's own writer makes
plain, uncompressed WARC/1.1 files in the shared folder.  ``read_archives`` reads files of any size in byte ranges:
Spark's text reader parts them at every line that begins with the record magic, so a task sees its range's pieces, and
prefix sums of their lengths tell where each stands.  Each piece that begins with a header is a candidate and tells
where its successor would begin.  Pointer jumping from the file's start then marks the candidates that the chain
reaches: after k rounds a candidate points 2**k records on; for that, a file's candidates, without their payloads, go
to one task.  Magic inside a payload is on no chain and is rejected; the pieces of a record that holds some are read
again and put together.

Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response and the
others are revisits, which carry the digest, the HTTP head and the id of the response and no payload.

Defined results.  A null html is an empty payload, a null url leaves the header out.  A null page_id is smaller
than any; rows that share the largest page_id are all responses.  White space and control characters in a url
become %20 in its header.  A header, and a payload that Java can hold (2 GB), may be of any length; a header ends at its
first empty line, and a line that is no field and continues none makes the place no record.  A file's chain ends at the
first place where no record begins; a file of which it is not the end is an error.  Repeated pages each have their
record.  An empty table makes no record.  Only page_id, url and html are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import Tables, join_unique, settings, shared_path

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
MOST_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: What parts a file into pieces: the magic at the start of a line.
SPLIT = b"\nWARC/1."
#: Pieces are handed to Python so many at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
FIELDS = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, intact boolean"
PIECE = "file string, block bigint, seq bigint, size bigint, n bigint, head bigint, length bigint, whole boolean, " + FIELDS
PLACED = "file string, block bigint, seq bigint, size bigint, offset bigint, next bigint, whole boolean, " + FIELDS
RECORD = "file string, offset bigint, next bigint, " + FIELDS
REACHED = "file string, block bigint, seq bigint, offset bigint, next bigint, owner bigint, " + FIELDS


def decide(spark: SparkSession, pages: DataFrame, tables: Tables, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest and refers_to, null for a response."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("rows")).filter("rows > 1")
    groups = tables.cut(groups, "payload-groups")
    rows = join_unique(rows, groups, ["digest"])
    again = (F.octet_length("payload") >= least) & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.withColumn("refers_to", F.when(again, F.col("keep"))).drop("keep")


def record_text(rows: DataFrame) -> DataFrame:
    """One column, value: the record without its last separator."""
    n = F.octet_length("payload").cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(spark: SparkSession, pages: DataFrame, tables: Tables) -> str:
    """Writes a record a page; returns the folder of the archives."""
    # a byte of a url may become three
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)).cast("bigint")
    n, total = pages.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    records = max(1, min(MOST_RECORDS, ARCHIVE_BYTES // (total // max(1, n) + 1024)))
    path = shared_path(spark, "warc")
    text = record_text(decide(spark, pages, tables))
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        text.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", records).text(path)
    return path


def _header(data: bytes, at: int, end: int) -> dict[bytes, bytes]:
    out = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


def _header_end(data: bytes, at: int) -> int:
    """Where the empty line after the header at ``at`` begins; -1 if a line before it is no field.

    The magic is no field, so no search goes on behind the next one, and all searches of a file are linear.
    """
    end = data.find(b"\r\n", at)
    while end >= 0:
        begin = end + 2
        after = data.find(b"\r\n", begin)
        if after == begin:
            return end
        if after < 0 or (data.find(b":", begin, after) < 0 and data[begin : begin + 1] not in (b" ", b"\t")):
            return -1
        end = after
    return -1


def parse_header(data: bytes) -> tuple[int, dict[bytes, bytes], int] | None:
    """Of a record that would begin here: its header's length, fields and its content's length; None if it can't be one."""
    if not MAGIC.match(data):
        return None
    end = _header_end(data, 0)
    if end < 0:
        return None
    head = _header(data, 0, end)
    length = head.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 12:
        return None
    return end + 4, head, int(length)


def fields(head: dict[bytes, bytes], content: memoryview | None) -> tuple:
    """FIELDS of a record; without its content only what the header tells."""
    text = lambda k: head[k].decode("utf-8", "replace") if k in head else None
    told = (text(b"warc-type") or "", text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"))
    digest = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    if content is None:
        return *told, digest, None, None
    size, intact = len(content), True
    if head.get(b"content-type", b"").startswith(b"application/http"):
        data = bytes(content)
        split = data.find(b"\r\n\r\n")
        inner = _header(data, 0, split) if split >= 0 else {}
        content = content[split + 4 :] if split >= 0 else content
        size = len(content)
        if told[0] == "revisit":
            n = inner.get(b"content-length", b"")
            size = int(n) if n.isdigit() else 0
    if told[0] == "response":
        found = hashlib.sha1(content).hexdigest()
        intact, digest = found == digest or not digest, found
    return *told, digest, size, intact


def parse_record(data: bytes) -> tuple | None:
    """FIELDS of the record that ``data`` is as a whole, with its separator; None if it is none."""
    found = parse_header(data)
    if found is None or found[0] + found[2] + 4 != len(data) or data[-4:] != b"\r\n\r\n":
        return None
    return fields(found[1], memoryview(data)[found[0] : -4])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, number in the block, file's size, piece); a block's pieces come one after the other."""
    at, seq = None, 0
    for batch in batches:
        for file, block, size, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            at, seq = (file, block), seq + 1 if (file, block) == at else 0
            yield file, block, seq, size, value


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.record_batch([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=names)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of files, with what their headers tell of a record that would begin there."""
    none = (None, None, False, *[None] * len(FIELDS.split(", ")))
    rows: list[tuple] = []
    for file, block, seq, size, value in _numbered(batches):
        # the file's first piece begins with the magic, from the others it was cut off
        first = block == 0 and seq == 0
        data = value if first else SPLIT[1:] + value
        found = parse_header(data + SPLIT[:1])  # the last line break may be the magic's
        tail = none
        if found:
            head, told, length = found
            # a record's last byte is the first of the magic's line break
            whole = head + length + 4 - len(data) in (0, 1) and (data + SPLIT[:1])[head + length : head + length + 4] == b"\r\n\r\n"
            tail = (head, length, whole, *fields(told, memoryview(data)[head : head + length] if whole else None))
        rows.append((file, block, seq, size, len(value), *tail))
        if len(rows) >= 4096:
            yield _table(rows, PIECE)
            rows = []
    if rows:
        yield _table(rows, PIECE)


def jump(offset: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets pointer jumping reaches from offset 0; ``following``: where each one's successor is."""
    i = np.minimum(np.searchsorted(offset, following), max(0, len(offset) - 1))
    end = len(offset)
    ahead = np.append(np.where(offset[i] == following, i, end), end)
    reached = np.append(offset == 0, False)
    while True:
        after = reached.copy()
        after[ahead[np.flatnonzero(reached)]] = True
        after[end] = False
        if (after == reached).all():
            return reached[:end]
        reached, ahead = after, ahead[ahead]


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of PLACED to REACHED: the records of each file's chain, and the pieces inside records that hold magic."""
    names = [c.split()[0] for c in REACHED.split(", ")]

    def done(file: pa.Table) -> pa.Table:
        offset = file["offset"].to_numpy()
        chosen = jump(offset, file["next"].fill_null(-1).to_numpy())
        at = np.flatnonzero(chosen)
        ends = file["next"].take(pa.array(at)).to_numpy()
        size = file["size"][0].as_py()
        if not len(at) or ends[-1] != size:
            raise ValueError(f"the records of {file['file'][0].as_py()} do not reach its end")
        broken = ~file["whole"].to_numpy()[at]
        # the record that each piece is in, if that has several pieces
        inside = np.searchsorted(offset[at], offset, "right") - 1
        owner = pa.array(np.where(broken[inside], offset[at][inside], 0), mask=~broken[inside])
        file = file.append_column("owner", owner).select(names)
        return file.filter(pa.array(chosen | broken[inside]))

    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        files = batch.column("file").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and files[a] != name:
                yield from done(pa.Table.from_batches(held)).to_batches()
                held = []
            if b > a:
                name = files[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield from done(pa.Table.from_batches(held)).to_batches()


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (file, offset, next, parts) put together from their pieces."""
    for batch in batches:
        rows = []
        for file, offset, after, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            values = [p["value"] for p in sorted(parts, key=lambda p: p["at"])]
            data = SPLIT.join(values) + SPLIT[:1]
            data = data if offset == 0 else SPLIT[1:] + data
            # the last record of a file has no magic behind it
            found = parse_record(data[: after - offset])
            if found is None:
                raise ValueError(f"the record of {file} at {offset} can't be read")
            rows.append((file, offset, after, *found))
        yield _table(rows, RECORD)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, value) of the pieces of the files in a folder; ``block``: where the task's range begins."""
    text = spark.read.option("lineSep", SPLIT.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def placed(found: DataFrame) -> DataFrame:
    """The pieces by PLACED, with the offsets of the records that would begin there, by prefix sums of the lengths."""
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("n") + len(SPLIT)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", base.alias("base"))
    own = F.coalesce(F.sum(F.col("n") + len(SPLIT)).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("base") + F.col("own")
    offset = F.when(start == 0, start).otherwise(start - (len(SPLIT) - 1))
    rows = found.withColumn("own", own).join(blocks, ["file", "block"]).withColumn("offset", offset)
    rows = rows.withColumn("next", F.col("offset") + F.col("head") + F.col("length") + 4)
    return rows.select(*[c.split()[0] for c in PLACED.split(", ")])


def read_archives(spark: SparkSession, path: str, tables: Tables) -> DataFrame:
    """The records of the WARC files in a folder, by RECORD; ``intact``: the digest told is that of the bytes."""
    # pieces are named by their range, so both readings part the files alike, whatever executors there are
    same = FEW_ROWS | {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    found = tables.cut(pieces(spark, path).mapInArrow(_candidates, PIECE), "candidates", same)
    rows = placed(found).repartition("file").sortWithinPartitions("file", "offset")
    reached = tables.cut(rows.mapInArrow(_reach, REACHED), "reached")
    tables.drop(found)
    names = [c.split()[0] for c in RECORD.split(", ")]
    records = reached.filter("owner is null").select(*names)
    broken = reached.filter("owner is not null").select("file", "block", "seq", "owner", F.when(F.col("owner") == F.col("offset"), F.col("next")).alias("next"), F.col("offset").alias("at"))
    if broken.isEmpty():
        return records
    texts = pieces(spark, path).mapInArrow(_again, "file string, block bigint, seq bigint, value binary").join(broken, ["file", "block", "seq"])
    texts = tables.cut(texts, "inner-pieces", same)
    parts = texts.groupBy("file", F.col("owner").alias("offset")).agg(F.max("next").alias("next"), F.collect_list(F.struct("at", "value")).alias("parts"))
    mended = tables.cut(parts.mapInArrow(_whole_records, RECORD), "mended", FEW_ROWS)
    tables.drop(texts)
    return records.union(mended.select(*names))


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for file, block, seq, _, value in _numbered(batches):
        rows.append((file, block, seq, value))
        size += len(value)
        if size > 1 << 20:
            yield _table(rows, "file string, block bigint, seq bigint, value binary")
            rows, size = [], 0
    if rows:
        yield _table(rows, "file string, block bigint, seq bigint, value binary")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them: a row a page."""
    tables = Tables(spark)
    path = write_archives(spark, pages, tables)
    records = read_archives(spark, path, tables)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
        "intact",
    )
