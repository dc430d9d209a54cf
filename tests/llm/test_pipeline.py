from pathlib import Path

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from .helpers import documents, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    passage, test = words(500, 70), words(501, 20)
    rows = [(i, words(i, 60, size=300), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, words(700 + i, 40, size=300) + " moron " + words(800 + i, 5), "en", "s0") for i in range(20)]
    rows += [(200, rows[3][1], "en", "s1"), (201, rows[3][1] + " more", "en", "s1"), (202, words(900, 30) + " " + passage, "en", "s2"), (203, words(901, 30) + " " + passage + " " + words(902, 20), "en", "s2"), (204, words(903, 20) + " " + test, "en", "s2"), (205, None, "en", "s0"), (206, "", "en", None)]
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(100 <= r[0] < 120)) for r in rows if r[0] < 200], "doc_id bigint, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, test)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, passage


def test_stages_take_effect(spark, tables, tmp_path):
    d, rows, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        assert out.columns[: len(columns)] == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeats", "contamination", "mixture"]
    assert not any(100 <= i < 120 for i in seen["toxicity"]) and len(seen["toxicity"]) == len(rows) - 20
    assert 3 in seen["near_duplicates"] and 200 not in seen["near_duplicates"] and set(range(80)) <= set(seen["near_duplicates"])
    assert passage in seen["repeats"][202].text and passage[20:-20] not in seen["repeats"][203].text
    assert seen["repeats"][203].n_chars == len(seen["repeats"][203].text)
    assert seen["repeats"].keys() - seen["contamination"].keys() == {204}
    taken = seen["mixture"]
    assert all(0 < r.taken <= 3 * len(r.text.split()) for r in taken.values()) and taken.keys() <= seen["contamination"].keys()


def test_columns_of_any_name_pass_through(spark, tables):
    d, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    names = ("taken", "_quire_score", "_quire_taken", "_quire_spans", "_quire_key", "fp", "score")
    docs = docs.select("*", *[F.col("doc_id").alias(n) for n in names])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        want = [c for c in docs.columns if c != "taken"] + ["taken"] if name == "mixture" else docs.columns
        assert out.columns == want
        assert all(r[n] == r.doc_id for r in out.collect() for n in names[1:])


def test_run_and_empty_tables(spark, tables, tmp_path):
    d, *_ = tables
    assert cp.run(spark, d).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(Path(tmp_path))).collect() == []
