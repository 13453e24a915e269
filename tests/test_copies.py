"""A copy of a table with rows that can't be copied: nothing is lost, and the counts agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import quality, sanitizing


def test_round_trip_with_bad_rows(spark, tmp_path):
    rows = [(k, "{}" if k % 4 else "{", "2026-01-01 00:00:00" if k % 6 else "never", None) for k in range(60)] + [(99, None, "", "x")]
    source = spark.createDataFrame(rows, "id int, tags string, at string, more string")
    good, bad = sanitizing.copied(source, str(tmp_path / "copy"), str(tmp_path / "rejects"), ["tags"], ["at"])
    assert good + bad == len(rows) and bad == sum(k % 4 == 0 or k % 6 == 0 for k in range(60))
    copy, rejects = spark.read.parquet(str(tmp_path / "copy")), spark.read.parquet(str(tmp_path / "rejects"))
    assert dict(copy.dtypes)["at"] == "timestamp" and dict(rejects.dtypes)["at"] == "string"
    assert sorted(r["id"] for r in copy.select("id").union(rejects.select("id")).collect()) == sorted(r[0] for r in rows)
    assert {tuple(r["problems"]) for r in rejects.where("id in (0, 4, 6)").collect()} == {("tags: not JSON", "at: not a time"), ("tags: not JSON",), ("at: not a time",)}
    counted = copy.agg(F.count(F.lit(1)).alias("n")).select(quality.copy_matches(F.lit(good), F.col("n")).alias("same")).first()
    assert counted["same"]


def test_without_columns_to_coerce(spark):
    good, bad = sanitizing.coerced(spark.range(3))
    assert good.count() == 3 and bad.count() == 0
