"""Operator 2: exact round trips, and captures whose records are incomplete."""

from __future__ import annotations

import glob
import gzip
import hashlib

from tests.oracle import connect, spark_rows, sql_rows
from waymark.llm import entries, warc

LONG = "<p>" + "long enough to be revisited " * 8 + "</p>"
PAGES = [
    (1, "http://a/1", "<p>small</p>"),
    (2, "http://a/2", "<p>small</p>"),
    (5, "http://a/5", LONG),
    (3, "http://a/3", LONG),
    (4, None, LONG),
    (6, "http://a/6", None),
    (7, "http://a/7\r\nX: y", ""),
    (8, "http://a/8", "WARC/1.1\r\nWARC-Type: response\r\n\r\nlooks like a record\r\n\r\n" * 5),
    (9, "http://a/9", "ünï 漢字 \U0001f600\r\n\r\n\r\n" * 30),
    (9, "http://a/9", "ünï 漢字 \U0001f600\r\n\r\n\r\n" * 30),
    (None, "http://a/none", LONG),
    (10, "http://a/10", "x" * 400_000),
    (11, "http://a/11", "y" * 99),
    (12, "http://a/12", "y" * 99),
    (13, "http://a/13", "z" * 100),
    (14, "http://a/14", "z" * 100),
]
SCHEMA = "page_id long, url string, html string"


def expected(pages):
    first: dict[str, int] = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            key = hashlib.sha256(data).hexdigest()
            first[key] = min(i, first.get(key, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        key = hashlib.sha256(data).hexdigest()
        again = i is not None and first.get(key, i) < i
        out.append((str(i), len(data), key, "revisit" if again else "response", str(first[key]) if again else "None"))
    return sorted(out)


def result(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in df.collect())


def test_round_trip_with_edges(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], SCHEMA + ", payload string, n long").repartition(3)
    assert result(warc.round_trip(pages, str(tmp_path / "a"))) == expected(PAGES)


def test_many_copies_of_one_payload(spark, tmp_path):
    pages = [(k, f"http://b/{k}", LONG) for k in range(400)] + [(1000 + k, f"http://c/{k}", f"{k} {LONG}") for k in range(50)]
    assert result(warc.round_trip(spark.createDataFrame(pages, SCHEMA), str(tmp_path / "b"))) == expected(pages)


def test_copies_among_pages_that_occur_once_and_long_payloads_in_one_file(spark, tmp_path):
    once = [(k, f"http://d/{k}", f"<p>{k} " + "unlike all others " * 9 + "</p>") for k in range(300)]
    again = [(1000 + k, f"http://e/{k}", once[k % 40][2]) for k in range(90)]
    long = [(5000 + k, f"http://f/{k}", f"{k} WARC/1.1\r\n\r\n" + f"{k % 7}" * 1_000_000) for k in range(60)]
    pages = once + again + long
    frame = spark.createDataFrame(pages, SCHEMA).coalesce(1)
    assert result(warc.round_trip(frame, str(tmp_path / "f"))) == expected(pages)
    assert len(glob.glob(f"{tmp_path}/f/*.gz")) <= 3
    kept = warc.with_revisits(frame)
    assert kept.where("first_id is not null").count() == 90 and kept.count() == len(pages)


def test_plain_archives(spark, tmp_path):
    folder = str(tmp_path / "g")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder)
    (tmp_path / "plain").mkdir()
    for k, name in enumerate(glob.glob(f"{folder}/*.gz")):
        (tmp_path / "plain" / f"{k}.warc").write_bytes(gzip.decompress(open(name, "rb").read()))
    rows = lambda df: sorted(map(str, df.select("record_id", "record_type", "payload").collect()))
    assert rows(warc.read_records(spark, str(tmp_path / "plain"), plain=True)) == rows(warc.read_records(spark, folder))


def test_archives_are_warc(spark, tmp_path):
    folder = str(tmp_path / "c")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder)
    seen = []
    for name in glob.glob(f"{folder}/*.gz"):
        plain = gzip.decompress(open(name, "rb").read())
        seen += [(head["warc-type"], len(block)) for head, block in warc.parse_records(plain)]
        assert [h for h, _ in warc.parse_records(plain)] == [h for h, _ in warc.parse_records(open(name, "rb").read())]
    assert len(seen) == 3 * len(PAGES) and {k for k, _ in seen} == {"request", "response", "revisit", "metadata"}


def test_one_nested_row_for_each_capture(spark, tmp_path):
    folder = str(tmp_path / "d")
    warc.write_archives(spark.createDataFrame(PAGES[:5], SCHEMA), folder)
    records = warc.read_records(spark, folder)
    captures = warc.assemble(records).collect()
    assert len(captures) == 5
    for c in captures:
        assert c["n_response"] == c["n_request"] == c["n_metadata"] == 1 and c["response"]["intact"] in (True, None)
    assert sorted(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["record_type"] == "response") == sorted(["<p>small</p>", "<p>small</p>", LONG])
    partial = warc.assemble(records.where("record_type <> 'response' and record_type <> 'revisit'")).collect()
    assert len(partial) == 5 and all(c["response"] is None and c["request"] is not None and c["metadata"] is not None for c in partial)


def test_metadata_that_names_the_request_and_requests_named_by_the_response(spark):
    rows = [
        ("r1", "response", "q1", None, "u", "d", 1, "x", True, {}, b"p"),
        ("q1", "request", None, None, "u", "d", 1, None, None, {}, None),
        ("m1", "metadata", "q1", None, "u", "d", 1, None, None, {"k": "v"}, None),
        ("m0", "metadata", "r1", None, "u", "d", 1, None, None, {"k": "first"}, None),
        (None, "metadata", "r1", None, "u", "d", 1, None, None, {}, None),
    ]
    (c,) = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert c["capture_id"] == "r1" and c["request"]["record_id"] == "q1" and c["metadata"]["record_id"] == "m0" and c["n_metadata"] == 2


def test_broken_archives_are_refused():
    import pytest

    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10"))
    with pytest.raises(ValueError):
        list(warc._pieced(iter([b"", b"1\r\nContent-Length: 10\r\n\r\nshort"])))


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")).collect() == []


def test_sql(spark, sf_dir):
    assert spark_rows(entries.op2_warc(spark, sf_dir)) == sql_rows(connect(sf_dir), entries.OP2)
