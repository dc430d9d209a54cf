"""What a task holds of a batch is bounded by bytes, whatever the batch has."""

import pyarrow as pa

from quire.operators import chunks as K
from quire.operators.rows import sliced


def _batch(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_parts_have_all_rows_in_order_and_a_bound():
    texts = ["a" * 300, None, "b" * 900, "c" * 5000, "", "d" * 10]
    parts = list(sliced([_batch(texts), _batch([])], ("text",), 1000))
    assert [x for p in parts for x in p["text"].to_pylist()] == texts
    assert [p["doc_id"].to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5]]


def test_a_large_batch_of_texts_is_chunked_in_parts():
    texts = ["ä" * 500] * 5000  # 5 MB
    parts = list(K._rows(lambda t: [(0, len(t), t)])([_batch(texts)]))
    assert len(parts) >= 5 and sum(p.num_rows for p in parts) == 5000
    assert max(p.nbytes for p in parts) < 2_000_000
