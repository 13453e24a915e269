"""Publications that stop between batches and within one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.oracle import spark_rows
from waymark.operators import commits, publishing


def test_a_stopped_run_goes_on(spark, tmp_path):
    current = spark.range(700).select(F.col("id").alias("k"), F.lit("old").alias("phone"), F.lit(None).cast("string").alias("site"))
    desired = spark.range(100, 900).select(F.col("id").alias("k"), F.concat(F.lit("new"), F.col("id")).alias("phone"), F.when(F.col("id") % 2 == 0, "s").alias("site"))
    changes = publishing.plan(current, desired, "k", ["phone", "site"])
    whole = publishing.applied(current, changes, "k", ["phone", "site"])
    run = commits.Publication(spark, str(tmp_path / "run"))
    run.plan(changes, "k", 50)
    assert run.log().count() == 0 and spark_rows(run.state(current, "k", ["phone", "site"])) == spark_rows(current)
    assert not run.run(group=3, groups=2) and run.done() == 6
    halfway = run.state(current, "k", ["phone", "site"])
    assert halfway.where("phone like 'new%'").count() == 300 and run.log().select("k").distinct().count() == 300
    # The run stops after a group was logged and before it was marked: it isn't done, and is logged again in its place.
    run.log_group(6, 9)
    assert run.done() == 6 and run.log().select("k").distinct().count() == 300
    assert commits.Publication(spark, str(tmp_path / "run")).run(group=5)
    assert spark_rows(run.state(current, "k", ["phone", "site"])) == spark_rows(whole)
    assert spark_rows(run.log().drop("batch")) == spark_rows(changes.select(*run.log().drop("batch").columns))
    sizes = [r["n"] for r in run.log().groupBy("batch").agg(F.countDistinct("k").alias("n")).collect()]
    assert sorted(sizes) == [50] * 16 and run.run()


def test_an_empty_plan(spark, tmp_path):
    run = commits.Publication(spark, str(tmp_path / "run"))
    run.plan(spark.createDataFrame([], "k long, field string, action string, old_value string, new_value string"), "k")
    assert run.run() and run.log().count() == 0
