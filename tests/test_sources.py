"""Files in and out."""

from __future__ import annotations

import struct
import zipfile

from pyspark.sql import functions as F

from waymark.sources import files


def test_csv_round_trip_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id long, name string, other string")
    files.write_csv(df, str(tmp_path / "c"), ["name", "id"])
    found = files.csv_if_there(spark, str(tmp_path / "c"), "name string, id long")
    assert sorted(found.collect(), key=lambda r: r["id"]) == [("a", 1), (None, 2)]
    assert files.csv_if_there(spark, str(tmp_path / "none"), "name string") is None


def test_piped_text(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("12|Caf\xe9 | LA|CA\n\nshort|line\n13|B|SF|OR|more\n".encode("latin-1"))
    found = files.piped_text(spark, str(tmp_path / "p.txt"), ["id", "name", "city", "state"], F.col("state") == "CA").collect()
    assert found == [("12", "Café", "LA", "CA")]


def test_zipped_dbf(spark, tmp_path):
    field = lambda name, n: name.encode().ljust(11, b"\x00") + b"C" + b"\x00" * 4 + bytes([n]) + b"\x00" * 15
    rows = [b" 101  Main St ", b"*102  Gone    ", b" 103  Oak     "]
    data = b"\x03" + b"\x00" * 3 + struct.pack("<IHH", 3, 32 + 64 + 1, 14) + b"\x00" * 20 + field("TLID", 5) + field("NAME", 8) + b"\x0d" + b"".join(rows)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.dbf", data)
        z.writestr("t.txt", "no")
    found = files.zipped_dbf(spark, str(tmp_path / "t.zip")).collect()
    assert [r["fields"] for r in found] == [{"TLID": "101", "NAME": "Main St"}, {"TLID": "103", "NAME": "Oak"}]


def test_fenced_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n```json\n{\"a\": 1}\n```\ntext\n```\nno\n```\n```json\n{}\n```\n")
    assert [(r["place"], r["block"]) for r in files.fenced_blocks(spark, str(tmp_path / "a.md")).collect()] == [(0, '{"a": 1}'), (1, "{}")]


def test_copies_and_receipts(spark, tmp_path):
    df = spark.range(2000).withColumnRenamed("id", "k")
    assert files.copied_whole(df, df.limit(1999)).first()["agrees"] and not files.copied_whole(df.limit(10), df.limit(9)).first()["agrees"]
    files.write_with_receipt(df, str(tmp_path / "r"), "abc")
    assert files.bound_rows(spark, str(tmp_path / "r"), "abc").count() == 2000 and files.bound_rows(spark, str(tmp_path / "r"), "other").count() == 0
