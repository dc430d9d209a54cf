"""Books made of the documents: the same rules in Spark and in SQL give their texts headings, speeches, wraps and noise.

The synthetic documents have lines and sentences and little else; over these books the operators of prose meet what
they are for, on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (pattern, replacement), in a dialect that Java and RE2 share.
RULES = (
    ("\nTh", "\n\nChapter 7: Th"),
    ("\nA", "\n\n“A"),
    ("\nO", "\n— O"),
    ("\nE", "\n***\nE"),
    ("\nI", "\n\nPrologue\n\nI"),
    ("\nW", "\n## W"),
    ("\nN", "\nCHAPTER 3\nThe Last On THEN N"),
    ("\nR", "\n12\nR"),
    ("\\. On", ".” “On"),
    ("\\. To", "… To"),
    ("\\. Be", ".\n\nStay up to date with Be"),
    ("\\. Is", ".\nVisit us online Is"),
    ("\\. Of", ".\n- Of"),
    ("\\. An", "!\n“An"),
    ("\\. Re", ".\n\nDisse Mara.\n— disse Mara, e Re"),
    (", a", " — a"),
    (" that ", "\nthat "),
    (" que ", "\nque "),
    (" und ", "-\nund "),
    (" la ", " ela "),
    (" el ", " ele "),
    (" los ", " ele "),
    (" der ", " senhor der "),
    (" dem ", " morreu dem "),
    (" des ", " apareceu vivo des "),
)


def book(c: Column) -> Column:
    """``c`` by ``RULES``, whose patterns are plain text with points escaped, so that no pattern is needed here."""
    for pattern, by in RULES:
        c = F.replace(c, F.lit(pattern.replace("\\.", ".")), F.lit(by))
    return c


def books(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.withColumn("text", book(F.col("text")))


def sql(x: str) -> str:
    for pattern, by in RULES:
        quoted = "'" + by.replace("'", "''") + "'"
        x = f"regexp_replace({x}, '{pattern}', {quoted}, 'g')"
    return x


BOOKS = f"books AS (SELECT doc_id, lang, source, {sql('text')} AS text FROM documents)"
#: Terms of the parts table: its names are keys, its types and brands what they are called.
TERMS = "g AS (SELECT p_partkey AS pos, p_name AS key, p_type AS pt, CASE WHEN p_size % 3 = 0 THEN 'dynamic' ELSE 'manual' END AS source, p_size % 5 = 0 AS locked, [p_name, lower(p_brand), p_type || ' senhor'] AS aliases, [lower(p_brand), p_name] AS old FROM part)"


def terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary of the parts table, by ``glossary.SCHEMA``, with the aliases of an older form."""
    p, none = spark.read.parquet(f"{d}/part.parquet"), F.lit(None)
    empty = F.array().cast("array<string>")
    return p.select(
        F.col("p_partkey").cast("int").alias("pos"), F.col("p_name").alias("key"), F.col("p_type").alias("pt"), none.cast("string").alias("category"), none.cast("string").alias("notes"),
        F.when(F.col("p_size") % 3 == 0, "dynamic").otherwise("manual").alias("source"), (F.col("p_size") % 5 == 0).alias("locked"),
        F.array("p_name", F.lower("p_brand"), F.concat("p_type", F.lit(" senhor"))).alias("source_aliases"), empty.alias("bad_aliases"), empty.alias("allowed_target_aliases"),
        F.lit(False).alias("source_case_sensitive"), F.lit(False).alias("enforce"), none.cast("string").alias("gender"), F.array(F.lower("p_brand"), F.col("p_name")).alias("aliases"),
    )
