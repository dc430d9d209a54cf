"""Corpus metrics of hypotheses against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

WORDS, CHARACTERS, BETA = 4, 6, 2.0


def _grams(units: Column, most: int) -> Column:
    each = lambda n: F.when(F.size(units) >= n, F.transform(F.sequence(F.lit(1), F.size(units) - n + 1), lambda i: F.struct(n.cast("bigint").alias("n"), F.array_join(F.slice(units, i, n), "\x1f").alias("g"))))
    return F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), each), lambda x: x.isNotNull()))


def _matches(samples: DataFrame, units, most: int) -> DataFrame:
    """(n, matched, total, wanted): clipped n-gram matches over all samples."""
    count = lambda c, name: samples.select("id", F.explode(_grams(units(F.col(c)), most)).alias("x")).groupBy("id", "x.n", "x.g").agg(F.count("*").alias(name))
    both = count("hypothesis", "h").join(count("reference", "r"), ["id", "n", "g"], "full")
    zero = F.lit(0).cast("bigint")
    h, r = F.coalesce("h", zero), F.coalesce("r", zero)
    return both.groupBy("n").agg(F.sum(F.least(h, r)).alias("matched"), F.sum(h).alias("total"), F.sum(r).alias("wanted"))


def ngram_matches(samples: DataFrame) -> DataFrame:
    return _matches(samples, lambda c: F.split(T.squeeze(c), " "), WORDS).select("n", "matched", "total")


def corpus_scores(samples: DataFrame) -> DataFrame:
    """One row: BLEU with a brevity penalty, and chrF."""
    words = lambda c: F.split(T.squeeze(c), " ")
    sizes = samples.agg(F.sum(F.size(words(F.col("hypothesis")))).alias("h"), F.sum(F.size(words(F.col("reference")))).alias("r"))
    precision = ngram_matches(samples).agg(F.avg(F.when(F.col("matched") > 0, F.log(F.col("matched") / F.col("total")))).alias("mean"), F.min("matched").alias("least"), F.count("*").alias("orders"))
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    bleu = F.when((F.col("least") > 0) & (F.col("orders") == WORDS), 100 * brevity * F.exp("mean")).otherwise(0.0)
    letters = _matches(samples, lambda c: F.split(F.regexp_replace(c, r"\s+", ""), ""), CHARACTERS)
    part = letters.agg(F.avg(F.try_divide("matched", "total")).alias("p"), F.avg(F.try_divide("matched", "wanted")).alias("q"))
    chrf = F.coalesce(100 * F.try_divide((1 + BETA**2) * F.col("p") * F.col("q"), BETA**2 * F.col("p") + F.col("q")), F.lit(0.0))
    return sizes.crossJoin(precision).crossJoin(part).select(bleu.alias("bleu"), chrf.alias("chrf"))
