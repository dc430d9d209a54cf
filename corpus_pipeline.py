"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go; one document of each group of near copies stays (five-word shingles, Jaccard similarity 4/5);
byte strings that occurred earlier are cut out, by whole characters; documents that hold passages of the benchmark
go; and the sources are mixed to their weights.  All stages but the last return the columns of documents; the last
adds ``taken``, the words that the mix takes of a document, repeats counted, and leaves out documents of which it
takes none.

A null text is an empty one to every stage.  Empty tables give an empty result.  Columns besides those of
documents pass through, whatever their names, but for a column ``taken``, which the last stage sets anew.  What a
stage has written besides its result is deleted when the result is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, nearcopies, suffixdedup, toxicity
from quire.llm.shared import Tables, free_prefix, released, shared_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark, docs.select("doc_id", "text"), labels, Tables(spark))
    score = free_prefix(docs.columns) + "score"
    return toxicity.scored(spark, docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.representatives(spark, docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixdedup.dedup_texts(spark, docs)
    n = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = free_prefix(docs.columns) + "taken"
    mixed = mixing.mix(spark, docs).filter(F.col(taken) > 0)
    return mixed.select(*[c for c in docs.columns if c.lower() != "taken"], F.col(taken).alias("taken"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("contamination", contamination), ("mixture", mixture)]
#: Tokenised models, fingerprints and hash thresholds are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with released(spark):
            after = tables.cut(stage(spark, docs, sf_dir), path=path)
        tables.drop(docs)
        docs = after
    return docs
