"""How many tasks work is dealt over: joins whose result is many times their input, and results that are small."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Into how many parts the rows of one key are dealt, and how many tasks a core gets.
WAYS, TASKS = 16, 8
#: Narrow rows that a task has before there are more tasks than cores.
ROWS_A_TASK = 20_000
#: Of rows that meet in blocks: those of one key that a block has of either side, those of one list, and rows of the result for each task.
BLOCK, LEFT_LIST, RIGHT_LIST, RESULT_A_TASK = 1 << 13, 64, 1024, 1 << 25
#: Tasks that number the rows of one key for their lists.
LIST_WAYS = 4


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many narrow rows, in a task for each ROWS_A_TASK of them and one for each core at least; no shuffle.

    Where that many tasks are no fewer than those of a shuffle, df stays as it is.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK))
    return df.coalesce(n) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def spread_join(small: DataFrame, large: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join on the keys, as a hash join in a fixed number of tasks.

    A few frequent keys would make few tasks, and a small input few partitions, though the result is long. So the rows of
    `large` with one key are dealt into WAYS parts by their hash, and those of `small` go to each part.
    """
    n = TASKS * large.sparkSession.sparkContext.defaultParallelism
    # One struct is the key, so a key that is the same in all rows isn't folded away from it; null keys would be equal in it.
    to = lambda way: F.struct(*keys, way.cast("int").alias("_way")).alias("_to")
    dealt = large.dropna(subset=list(keys)).select("*", to(F.pmod(F.xxhash64(*large.columns), F.lit(WAYS))))
    each = small.dropna(subset=list(keys)).withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))).select(*[c for c in small.columns if c not in keys], to(F.col("_way")))
    joined = each.repartition(n, "_to").hint("shuffle_hash").join(dealt.repartition(n, "_to"), "_to")
    return joined.select(*keys, *[c for c in [*small.columns, *large.columns] if c not in keys])


def listed(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The rows of df that are equal in keys as lists of structs (`_list`) of so many at most, each with a hash of its place among them (`_nth`)."""
    rest = [c for c in df.columns if c not in keys]
    # In order of all columns, so a task that is run again makes the same lists.
    row = F.row_number().over(Window.partitionBy(*keys, "_way").orderBy(*rest)) - 1
    dealt = df.withColumn("_way", F.pmod(F.xxhash64(*rest), F.lit(LIST_WAYS))).withColumn("_nth", F.floor(row / most))
    lists = dealt.groupBy(*keys, "_way", "_nth").agg(F.collect_list(F.struct(*rest)).alias("_list"))
    return lists.select(*keys, F.xxhash64(*keys, "_way", "_nth").alias("_nth"), "_list")


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The inner join on the keys of what two sides of lists hold, for a result of about so many rows that is far longer than its input.

    Both sides: keys, _list, _nth, and _left and _right, the rows of either side that have the key. Lists are shuffled, not
    rows: those of a key are dealt over a grid of blocks of about BLOCK rows of either side, so a list goes to as many blocks
    as the other side has parts. A task gets about RESULT_A_TASK rows of the result, and lists of a block are paired and taken
    apart in it. So neither side of a key is wholly in one task, and a file that a task writes has few different values.
    """
    n = max(TASKS * left.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / RESULT_A_TASK))
    parts = lambda x: F.coalesce(F.ceil(F.col(x) / BLOCK).cast("int"), F.lit(1))
    every = lambda x: F.explode(F.sequence(F.lit(0), parts(x) - 1))
    own = lambda x: F.coalesce(F.pmod(F.col("_nth"), parts(x)).cast("int"), F.lit(0))
    # The same type on both sides, whether a field may be null included: else the join casts it and shuffles both sides again.
    to = F.struct(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"), "_row", "_column").alias("_to")
    a = left.withColumn("_row", own("_left")).withColumn("_column", every("_right")).select(*keys, to, F.col("_list").alias("_a"))
    b = right.withColumn("_column", own("_right")).withColumn("_row", every("_left")).select(to, F.col("_list").alias("_b"))
    met = a.repartition(n, "_to").hint("shuffle_hash").join(b.repartition(n, "_to"), "_to")
    # A step of its own between join and lists: else all rows that a list gives with all others of its block are held at once.
    # The shorter list last: long runs of one side and short cycles of the other are a tenth of a byte a row in a file.
    pairs = met.coalesce(n).withColumn("_b", F.explode("_b")).withColumn("_a", F.explode("_a"))
    return pairs.select(*keys, "_a.*", "_b.*")
