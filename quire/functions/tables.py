"""Table functions for SQL: chunkers of a text, and operators over partitions that come in order.

    tables.register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk_strict(text, 2400) c")
    spark.sql("SELECT * FROM recent_context(TABLE(SELECT id AS key, no AS seq, text FROM rows) PARTITION BY key ORDER BY seq)")

Rows travel in Arrow batches.  A function over a partition holds no more of it than its result needs: the last texts
within the context's bounds, or the stubs since the last chunk.  A null text is an empty one.  An empty text has no
chunks, and Spark drops its row in a LEFT JOIN LATERAL too (``chunks_in_sql`` of the queries keeps such rows).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quire.operators import chunks as K
from quire.operators.ordered import CONTEXT_CHARS, CONTEXT_ROWS

CHUNK = "chunk_idx bigint, start_offset bigint, end_offset bigint, chunk string"


class ChunkStrict:
    """The chunks of a text that end behind sentences or paragraphs."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        for i, row in enumerate(K.strict_rows(text or "", most)):
            yield i, *row


class ChunkQuotes:
    """The chunks of a text that keep speeches whole."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        for i, row in enumerate(K.quote_rows(text or "", most)):
            yield i, *row


class RecentContext:
    """Of each row (key, seq, text), the texts of the last rows before it, within a number of characters."""

    def __init__(self):
        self.texts: deque[str] = deque(maxlen=CONTEXT_ROWS)

    def eval(self, row: Row) -> Iterator[tuple]:
        left, picked = CONTEXT_CHARS, []
        for text in reversed(self.texts):
            if text and left > 0:
                cut = text[-left:].lstrip(" ") if len(text) > left else text
                picked.append(cut)
                left -= len(cut)
        yield row["key"], row["seq"], "\n\n".join(reversed(picked))
        self.texts.append(" ".join((row["text"] or "").split()))


class Sessions:
    """Of each row (key, seq, starts), the number of its session; a new one begins where ``starts`` holds."""

    def __init__(self):
        self.session = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.session += bool(row["starts"])
        yield row["key"], row["seq"], self.session


#: Name, class, and columns of the result.
FUNCTIONS = (
    ("chunk_strict", ChunkStrict, CHUNK),
    ("chunk_quotes", ChunkQuotes, CHUNK),
    ("recent_context", RecentContext, "key bigint, seq bigint, context string"),
    ("context_sessions", Sessions, "key bigint, seq bigint, session bigint"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL; returns their names."""
    for name, cls, columns in FUNCTIONS:
        spark.udtf.register(name, udtf(cls, returnType=columns, useArrow=True))
    return [name for name, _, _ in FUNCTIONS]
