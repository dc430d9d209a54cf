import hashlib

import numpy as np
import pytest

from quire.llm import warc
from quire.llm.shared import Tables

SCHEMA = "page_id bigint, url string, html string, payload string, rows string"


def pages():
    big = "<p>" + "copy " * 300 + "</p>"
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://h{i}.example/", big) for i in range(5)]
    rows += [(10, None, None), (11, "http://a b\r\n/", ""), (12, "u", "small"), (13, "u", "small"), (14, "u", inner * 3), (15, "u", "x" * 999), (16, "u", "x" * 999), (17, "ü", "é" * 600), (18, "ü", "é" * 600)]
    rows += [(None, "n", big), (20, "u", "twice" * 400), (20, "u", "twice" * 400), (21, "u", "\r\n\r\n" + inner + "WARC/1.1\r\n"), (22, "u", "y" * 300_000)]
    return [(*r, "a", "b") for r in rows]


def want(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        digest = hashlib.sha1(data).hexdigest()
        keep = max((r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == data), default=None)
        again = len(data) >= 1000 and keep is not None and page_id != keep
        out.append((page_id, len(data), digest, "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    out = warc.round_trip(spark, spark.createDataFrame(pages(), SCHEMA)).collect()
    assert all(r.intact for r in out)
    assert sorted((tuple(r)[:5] for r in out), key=str) == want(pages())


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture
def narrow(spark):
    """Byte ranges of some hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip_in_byte_ranges(spark, narrow):
    out = warc.round_trip(spark, spark.createDataFrame([r for r in pages() if r[0] != 22], SCHEMA).coalesce(1)).collect()
    assert all(r.intact for r in out)
    assert sorted((tuple(r)[:5] for r in out), key=str) == want([r for r in pages() if r[0] != 22])


def record(body):
    return b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), len(body), body)


def test_magic_inside_payloads_is_on_no_chain(spark, tmp_path, narrow):
    inner = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    bodies = [inner * 4, b"end", b"x" * 3000, b"WARC/1.", b"\nWARC/1.", b"a\nWARC/1.1\r\n" * 50, inner]
    data = b"".join(map(record, bodies))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(record(inner) + record(b"\r\n\r\n" + inner))
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.next, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path), Tables(spark)).collect())
    ends = [sum(len(record(b)) for b in bodies[:i]) for i in range(len(bodies) + 1)]
    assert [g for g in got if g[0] == "a.warc"] == [("a.warc", a, b, len(body)) for a, b, body in zip(ends, ends[1:], bodies, strict=False)]
    assert len(got) == len(bodies) + 2


def test_pointer_jumping():
    offset = np.arange(0, 1000, 10)
    assert warc.jump(offset, offset + 10).all()
    cut = np.delete(offset, 37)
    assert np.flatnonzero(warc.jump(cut, cut + 10)).tolist() == list(range(37))
    far = np.where(offset % 20 == 0, offset + 20, -1)
    assert warc.jump(offset, far).tolist() == [o % 20 == 0 for o in offset]
    assert warc.jump(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)).tolist() == []


def test_bad_candidates():
    assert warc.parse_header(b"WARC/1.1\r\nno end") is None
    assert warc.parse_header(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") is None
    assert warc.parse_header(b"WARC/1.2\r\nContent-Length: 1\r\n\r\n") is None
    assert warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n") is None
    assert warc.parse_record(record(b"short"))[5] == 5


def test_a_url_longer_than_64_kb_loses_no_page(spark):
    rows = [(i, f"http://h/{i}" + (" long" * 20_000 if i == 3 else ""), f"page {i}", "a", "b") for i in range(8)]
    out = warc.round_trip(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == want(rows)


def test_a_chain_that_ends_early_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"end") * 2)
    assert warc.read_archives(spark, str(tmp_path), Tables(spark)).count() == 2
    for bad in (record(b"end") + b"junk" + record(b"end"), record(b"end")[:-1], b"junk" + record(b"end")):
        (tmp_path / "b.warc").write_bytes(bad)
        with pytest.raises(Exception, match="b.warc"):
            warc.read_archives(spark, str(tmp_path), Tables(spark))
