"""Plans of changes in numbered batches that can be stopped and gone on with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.publishing import applied
from waymark.sources.store import checkpointed

#: Keys of a batch.
SIZE = 50


def numbered_batches(changes: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """The changes with `batch`: the keys in their order, so many to a batch, from 0; all changes of a key are in one.

    Keys are dealt out by ranges and numbered within each, so no task sees all of them; null keys have none.
    """
    keys = changes.select(key).where(F.col(key).isNotNull()).distinct()
    dealt = checkpointed(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    numbered = dealt.withColumn("_place", place).join(before, "_part").select(key, F.floor((F.col("_before") + F.col("_place")) / size).alias("batch"))
    return changes.join(numbered, key)


class Publication:
    """A run of a plan, in a folder that all executors share: the plan with its batches, a log by batch, and marks of what is done.

    A group of batches is logged, then marked. What was logged without a mark, because the run stopped in between, is logged
    again in its place; so each batch takes effect once, and its log is there once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def plan(self, changes: DataFrame, key: str, size: int = SIZE) -> None:
        """Writes the plan (key, field, action, old_value, new_value) with its batches; once for a run."""
        numbered_batches(changes, key, size).write.parquet(f"{self.folder}/plan")

    def _marks(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [int(f.getPath().getName()) for f in files.listStatus(path)] if files.exists(path) else []

    def done(self) -> int:
        """Up to which batch all are done; the next one's number."""
        return max(self._marks(), default=0)

    def log_group(self, first: int, end: int) -> None:
        """Logs the batches from first up to end, in place of what is there of them."""
        rows = self.spark.read.parquet(f"{self.folder}/plan").where(F.col("batch").between(first, end - 1))
        rows.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/log")

    def run(self, group: int = 200, groups: int | None = None) -> bool:
        """Does the batches that aren't done, so many at once, in so many groups at most; whether all are done."""
        last = self.spark.read.parquet(f"{self.folder}/plan").agg(F.max("batch")).first()[0]
        total = 0 if last is None else int(last) + 1
        while (first := self.done()) < total and (groups is None or groups > 0):
            end = min(total, first + group)
            self.log_group(first, end)
            mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{end}")
            mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()
            groups = None if groups is None else groups - 1
        return self.done() >= total

    def log(self) -> DataFrame:
        """The changes of the batches that are done: key, field, action, old_value, new_value, batch."""
        columns = self.spark.read.parquet(f"{self.folder}/plan")
        if not self.done():
            return columns.limit(0)
        rows = self.spark.read.parquet(f"{self.folder}/log").where(F.col("batch") < self.done())
        return rows.select(*[F.col(c).cast(t) for c, t in columns.dtypes])

    def state(self, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
        """current after the batches that are done."""
        return applied(current, self.log(), key, fields)
