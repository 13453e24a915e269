"""What the text operators share: byte blocks of Arrow batches, word hashes, checkpoints, joins on hot keys."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waymark.operators.spreading import in_few

#: Rows that go to a Python worker at once: a few MB of text, and one very long text costs no more than itself.
ARROW_ROWS = 512
#: Bytes of such a batch, so that rows with long texts make smaller ones.
ARROW_BYTES = 4_000_000
#: Bytes of text that one vectorised pass handles; a longer text makes a block of its own.
BLOCK_BYTES = 250_000

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the odd base of the polynomial that orders them.
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads what distinguishes the values over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Block:
    """The UTF-8 bytes of some texts one after another; offsets has where each begins, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text that each byte belongs to."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flags are set within each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each longest run of set flags that stays within a text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        begins = self.offsets[:-1][self.sizes > 0]
        first[begins] = inside[begins]
        ends = self.offsets[1:][self.sizes > 0] - 1
        last[ends] = inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def take(self, which: np.ndarray) -> Block:
        """The texts at these indices."""
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in which]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        return Block(np.concatenate(parts) if parts else self.data[:0], offsets)


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; none may be empty."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = ends - begins
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    values = _BYTE_VALUES[data[within + np.repeat(begins, sizes)]] * powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, at) + sizes.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, texts not regarded."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j, p in enumerate(powers(n + 1)[1:]):
        out += words[j : j + len(out)] * p
    return mix(out)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """The column's texts, null as empty, in blocks of about `most` bytes: first row, end row, block."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and where each text begins, with the end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def text_groups(texts: list[str], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of the list with about `most` characters each."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a worker holds a few MB of text whatever the rows are like.

    Spark reads these two settings when a query runs, which is after an operator has returned, so they stay set for the
    session; smaller batches that the user has asked for stay as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        known = spark.conf.get(key)
        if not known.isdigit() or not 0 < int(known) <= most:
            spark.conf.set(key, str(most))
    return spark


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies work to Arrow batches of df; no shuffle."""
    tuned(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(each, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Keeps the rows for which keep(column) is true, with all columns as they are."""
    tuned(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(column)), pa.bool_()))

    return df.mapInArrow(each, df.schema)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where none is set, as in tests, a local one for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that these operators wrote to the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffles of what is settled, and checkpoints (if the session says so), that nothing refers to any more.

    The cleaner learns of them when the driver collects garbage, which a driver with little to do seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: what follows doesn't compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settle_narrow(df: DataFrame) -> DataFrame:
    """settle() of narrow rows, counted as they are written: few are read in few tasks."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return in_few(out, seen.get["rows"])


def held_out(doc_id: Column) -> Column:
    """The rows that learning leaves aside: crc32 of the id as text, modulo 4, is 2. A null id is learned from never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


#: Words of 64 slots in the filter of may_match.
FILTER_WORDS = 1 << 18


def may_match(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key, a hash, may be in keys, by a filter of FILTER_WORDS * 64 slots that is broadcast.

    All that are there stay. A filter that is full lets all rows through.
    """
    word, bit = F.pmod(F.shiftright(F.col(key), 6), F.lit(FILTER_WORDS)).cast("int"), F.col(key).bitwiseAND(F.lit(63)).cast("int")
    slots = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return df.withColumn("_word", word).join(F.broadcast(slots), "_word").where(F.bit_get("_bits", bit) == 1).select(*df.columns)


def flagged(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """df with a flag of the rows that may_match() lets through."""
    word, bit = F.pmod(F.shiftright(F.col(key), 6), F.lit(FILTER_WORDS)).cast("int"), F.col(key).bitwiseAND(F.lit(63)).cast("int")
    slots = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return df.withColumn("_word", word).join(F.broadcast(slots), "_word", "left").withColumn(flag, F.coalesce(F.bit_get("_bits", bit) == 1, F.lit(False))).select(*df.columns, flag)


#: A key with more than one row in so many is hot: by arithmetic there are at most so many of them.
SHARE = 1000


def join_hot(left: DataFrame, groups: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """left joined to groups, which has one row for each key with the number of left's rows in `count`.

    Groups with over 1/SHARE of all rows, SHARE of them at most, are broadcast; their rows, and those without a key, take
    part in the shuffle under salts of their own that nothing matches. groups should be settled: it is read three times.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    others = [c for c in groups.columns if c not in (key, count)]
    is_hot = F.col(count) > F.greatest(F.lit(total / SHARE), F.lit(50))
    hot = groups.where(is_hot).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in others])
    light = groups.where(~is_hot).select(F.col(key).alias("_light_key"), F.lit(0).cast("long").alias("_light_salt"), *[F.col(c).alias(f"_light_{c}") for c in others])
    first = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    salted = first.withColumn("_salt", salt)
    both = salted.join(light, (F.col(key) == F.col("_light_key")) & (F.col("_salt") == F.col("_light_salt")), "left")
    if how == "inner":
        both = both.where("_hot_key is not null or _light_key is not null")
    return both.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_light_{c}").alias(c) for c in others])
