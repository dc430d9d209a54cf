"""A round's plan does not grow with the rounds before it, and an answer is named once in what is done to it."""

from pyspark.sql import functions as F

from quire.functions import rewrite as W
from quire.operators import wavefront as WF

ROUNDS = 12


def test_a_rounds_plan_does_not_grow_with_the_rounds_before_it(spark, monkeypatch):
    words = "amber birch cedar delta ember fjord grove heath islet joist knoll larch".split()
    texts = [f"{w} {w[::-1]} stood by {n} {w} gates." for n, w in enumerate(words)]
    rows = [(d, i, 0, t) for d in (1, 2) for i, t in enumerate([*texts[: ROUNDS - 1], texts[0]] if d == 1 else [x for t in texts[:4] for x in (t, t)])]
    reads, real = [], WF.scratch_table

    def counted(spark, df, name, by=None):
        if name == "round":
            reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation "))
        return real(spark, df, name, by)

    monkeypatch.setattr(WF, "scratch_table", counted)
    monkeypatch.setattr(WF, "MERGED", 2)
    answered = lambda now: now.select("doc_id", "chunk_idx", F.col("text").alias("raw"), F.upper("text").alias("output"), F.lit("ok").alias("status"), F.lit(1).alias("attempts"))
    done = WF.run(spark, spark.createDataFrame(rows, "doc_id bigint, chunk_idx bigint, section int, text string"), answered).collect()
    assert len(reads) == ROUNDS and max(reads) <= 2 + 2
    assert {(r.doc_id, r.chunk_idx): r.output for r in done} == {(d, i): t.upper() for d, i, _, t in rows}
    assert {(r.doc_id, r.chunk_idx) for r in done if r.how == "memory"} == {(1, ROUNDS - 1), (2, 1), (2, 3), (2, 5), (2, 7)}


def test_an_answer_is_named_once(spark):
    rows = spark.createDataFrame([("he parried", "ele parria e foi")], "s string, t string")
    one = rows.select(W.postprocess_translation(W.between_markers(F.upper("t")), F.col("s")).alias("x"))
    assert one._jdf.queryExecution().analyzed().toString().count("upper(t#") == 1
    assert rows.select(W.postprocess_translation(F.col("t"), F.col("s")).alias("x")).first().x == "ele aparava e foi"
