"""Lines are made once a row, white space goes as str.strip has it, and rules look only where they can hold."""

import re

from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import text as T
from quire.operators import lines as L
from quire.sources.io import noise_rules


def test_a_text_is_split_once(spark):
    docs = spark.createDataFrame([(1, "a\n\na\nb")], "doc_id bigint, text string")
    for operator in (L.remove_repeated, L.dedupe_consecutive, L.collapse_lines, L.dedupe_prefix):
        plan = operator(docs)._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") == 1, operator.__name__


def test_strip_takes_all_white_space_without_a_pattern(spark):
    texts = [" \t\x0b\x1c\x85\xa0  　a b​\r\n", "　", "", "x\n\x1f", "a\n "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip(F.col("t")).alias("s"))
    assert [r.s for r in rows.orderBy("i").collect()] == ["a b​", "", "", "x", "a"]
    assert "regexp" not in rows._jdf.queryExecution().analyzed().toString()


def test_patterns_that_can_only_begin_are_matched_there():
    patterns = [*noise_rules()["line_regex"], "^a|b", "^(?:a|b) c", r"^[|]x|y", r"^a\|b", "b$"]
    texts = ["", "  Sign up for our newsletter", "read. Visit us online", "xx b", "b c", "a|b", "|x", "wy"]
    for p in patterns:
        assert [bool(prose.finder(p)(t)) for t in texts] == [bool(re.search(p, t, re.I)) for t in texts]
    assert prose.finder("^(?:a|b) c").__name__ == "match" and prose.finder("^a|b").__name__ == "search"
