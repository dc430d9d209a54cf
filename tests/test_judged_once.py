"""An answer is computed once however much of it is judged, and hopeless pairs of texts are left early."""

import random

from pyspark.sql import functions as F

from quire.operators import chunks as K
from quire.operators import repair as RP


def test_a_chunks_answer_is_named_once_in_what_judges_it(spark):
    rows = spark.createDataFrame([("“Go.”\n\nHe went.", "“GO.”\n\nhe went.")], "b string, a string").withColumn("r", RP.refined_chunk(F.col("b"), F.upper("a")))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(a#") == 1
    assert rows.select("r.*").first().asDict() == {"text": "“GO.”\n\nHE WENT.", "ok": True, "soft_retry": False}


def test_a_comparison_ends_where_too_few_characters_are_left():
    looked = []

    class Text(str):
        def __getitem__(self, i):
            x = super().__getitem__(i)
            if isinstance(i, slice):
                x = Text(x)
            looked.append(i)
            return x

    r = random.Random(3)
    a, b = ("".join(r.choices("abcdefghij ", k=4000)) for _ in range(2))
    exact = K.in_common_order(a, b)
    assert K.in_common_order(a, Text(b), 3800) < 3800
    assert sum(isinstance(i, slice) for i in looked) < 12  # of 32 stretches
    assert [K.in_common_order(a, b, n) for n in (0, exact - 1, exact)] == [exact] * 3 and K.in_common_order(a, b, exact + 1) <= exact
