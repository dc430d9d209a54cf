"""Table functions give the rows of the DataFrame operators."""

import duckdb
from pyspark.sql import functions as F

from quire.functions import tables
from quire.operators import chunks as K
from quire.operators import ordered as O
from quire.plans import queries

TEXT = "One sentence here. “A speech that goes on. And on.” she said.\n\nAnother paragraph! Was it? " * 60


def test_chunkers_in_sql(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "short")], "doc_id bigint, text string")
    docs.createOrReplaceTempView("table_docs")
    assert tables.register(spark) == ["chunk_strict", "chunk_quotes", "recent_context", "context_sessions"]
    for name, operator in (("chunk_strict", K.chunk_strict), ("chunk_quotes", K.chunk_quotes)):
        got = spark.sql(f"SELECT doc_id, c.* FROM table_docs, LATERAL {name}(text, 120) c").collect()
        want = operator(docs, 120).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 5


def test_partitions_in_order(spark):
    rows = spark.createDataFrame([(k, s, None if s == 3 else f"text  {s} " * (60 * (s % 4))) for k in (1, 2) for s in range(9)], "key bigint, seq bigint, text string")
    rows.repartition(5).createOrReplaceTempView("table_rows")
    tables.register(spark)
    got = spark.sql("SELECT * FROM recent_context(TABLE(table_rows) PARTITION BY key ORDER BY seq)").collect()
    want = O.recent_context(rows, "key", "seq").select("key", "seq", "context").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = spark.sql("SELECT * FROM context_sessions(TABLE(SELECT key, seq, seq % 3 = 1 AS starts FROM table_rows) PARTITION BY key ORDER BY seq)").collect()
    want = O.context_sessions(rows, "key", "seq", F.col("seq") % 3 == 1).select("key", "seq", "session").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_chunks_in_sql_keep_texts_without_chunks(spark, tmp_path):
    rows = [(1, TEXT * 9), (2, ""), (3, None), (4, " \n\n "), (5, "short"), (5, "twice"), (None, "no id"), (6, "é")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["chunks_in_sql"](spark, str(tmp_path)).collect()
    documents = f"'{tmp_path}/documents.parquet/*.parquet'"
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM {documents}) {queries.SQL['chunks_in_sql']}").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == len(rows)
