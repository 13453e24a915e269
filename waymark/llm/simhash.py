"""Operator 7: near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits in two segments of 32, and for each segment there is a table of the fingerprints by its value.
Fingerprints that differ in at most two bits differ in at most one bit of some segment, so each enumerates, within each
segment, the Hamming ball of radius one (33 values), fetches what the table has there, and verifies complete distances.

A bucket of a table holds the fingerprints with one segment value; a group of many near copies may fill one. A bucket of
over DENSE fingerprints is split by the bits of the other segment: its fingerprints, and those whose balls reach it, then
meet at whole values within one bit of both, which at most 65 fingerprints share. So no probe fetches more than DENSE
candidates and no pair within the radius is missed. Exact copies collapse to one fingerprint before any of this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import flagged, join_hot, map_rows, release, settle, settle_narrow, text_groups
from waymark.operators.matching import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Fingerprints of a bucket that a probe compares one by one; larger buckets are split. Both ways find the same links.
DENSE = 64
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each UTF-8 text as an unsigned 64-bit number; zero without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(np.array([digest(joined, SEED)], dtype=np.uint64))
            counts[k] = 1
            continue
        ends = [0]
        at = -1
        for w in words:
            at += 1 + len(w)
            ends.append(at)
        # The shingle of words i..i+2 lies between the end of word i-1 (and a space) and the end of word i+2.
        ends[0] = -1
        counts[k] = len(words) - shingle + 1
        hashes.append(np.fromiter((digest(joined[a + 1 : b], SEED) for a, b in zip(ends[:-shingle], ends[shingle:], strict=True)), np.uint64, int(counts[k])))
    return majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[k] hashes, the bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Bytes of a word count up to 255 set bits each, so a run is summed in parts of that size.
    n_parts = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), n_parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    starts = np.repeat(np.cumsum(counts[full]) - counts[full], n_parts) + 255 * nth
    first = np.cumsum(n_parts) - n_parts
    for low in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(low)) & _LANES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= np.where(2 * ones[:, byte] > counts[full], np.uint64(1) << np.uint64(8 * byte + low), np.uint64(0))
    return out


def fingerprints(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row, and more longs of it; a null text has no words. No shuffle."""
    names = list(more or {})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
        found = np.concatenate([fingerprints_of(texts[i:j]) for i, j in text_groups(texts)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *[batch.column(c) for c in names]], ["doc_id", "fingerprint", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(name) for name, c in (more or {}).items()])
    return map_rows(rows, work, "".join(["doc_id long, fingerprint long", *[f", {c} long" for c in names]]))


def _flipped(value: Column, bits: range) -> list[Column]:
    return [value.bitwiseXOR(F.lit(int(np.uint64(1 << b).astype(np.int64)))) for b in bits]


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp) at RADIUS bits or fewer that connect all that are so near."""
    spark = distinct.sparkSession
    half = BITS // 2
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = settle(distinct.select("fp").repartition(tasks, "fp"))
    # The upper segment's values are told from the lower one's by a bit above them.
    low, high = F.col("fp").bitwiseAND(F.lit(2**half - 1)), F.shiftrightunsigned("fp", half).bitwiseOR(F.lit(2**half))
    table = spread.select("fp", F.explode(F.array(low, high)).alias("bucket"))
    crowded = settle_narrow(table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("bucket"))
    entries = table.join(crowded, "bucket", "left_anti").select("bucket", F.col("fp").alias("b"))
    entries = entries.union(crowded.select("bucket", F.lit(None).cast("long").alias("b")))
    balls = F.array(low, high, *_flipped(low, range(half)), *_flipped(high, range(half)))
    fetched = spread.select(F.col("fp").alias("a"), F.explode(balls).alias("bucket")).join(entries.hint("shuffle_hash"), "bucket").select("a", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    met = settle_narrow(fetched.where(F.col("b").isNull() | ((F.col("a") > F.col("b")) & near)).distinct())
    return met.where("b is not null").union(_links_by_whole_value(met.where("b is null").select(F.col("a").alias("fp")))).distinct()


def _links_by_whole_value(crowd: DataFrame) -> DataFrame:
    """Links of the fingerprints in and about crowded buckets: both segments' values name the bucket, and both are flipped.

    A pair within RADIUS bits has a value within one bit of both. All that meet there link to its smallest; these links
    connect what is near, and each is verified.
    """
    values = F.array(F.col("fp"), *_flipped(F.col("fp"), range(BITS)))
    met = crowd.select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    pairs = met.select(F.explode("all").alias("a"), "b").where("a != b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for every row.

    Repeated rows and ids stay and share a component if their fingerprints do; rows without an id get their
    component's, which is null only if no row of it has an id. An empty table gives no rows.
    """
    return with_components(settle(fingerprints(docs)))


def with_components(rows: DataFrame) -> DataFrame:
    """near_duplicates() of rows of doc_id, fingerprint and more."""
    groups = settle_narrow(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    label = settle_narrow(components(links(groups.select(F.col("fingerprint").alias("fp")))))
    joined = groups.join(label, groups.fingerprint == label.node, "left")
    linked = settle_narrow(joined.where("root is not null").select("fingerprint", "n", "root", "least_id"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    alone = joined.where("root is null and n > 1").select("fingerprint", "n", F.col("least_id").alias("component_id"))
    classes = settle_narrow(linked.join(least, "root").select("fingerprint", "n", "component_id").union(alone))
    out = join_hot(rows, classes, "fingerprint", "n")
    # A fingerprint that one row alone has, linked to no other, is a component of its own.
    more = [c for c in rows.columns if c not in ("doc_id", "fingerprint")]
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns.

    Rows without an id can't be told apart by one: they stay. Of rows of one group with its smallest id one text stays; a
    row repeated with its id and text stays once. A row whose id is first in another group goes all the same.
    """
    return first_of_each(docs, with_components(settle(fingerprints(docs, {"source": F.xxhash64(F.col("text").cast("string"))}))))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """one_of_each() of docs by the doc_id, source (xxhash64 of the text) and component_id of every row.

    Only rows that go or are repeated, as far as a filter of fixed size can tell them, are shuffled.
    """
    spark = docs.sparkSession
    named = settle_narrow(found.where("doc_id is not null").groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("component_id")))
    first = named.where("doc_id = component_id").groupBy("doc_id").agg(F.min("source").alias("_source"), F.lit(True).alias("_first"))
    judged = named.join(first, "doc_id", "left").withColumn("stays", F.coalesce((F.col("component_id") == F.col("doc_id")) & (F.col("source") == F.col("_source")), F.lit(False)))
    known = settle_narrow(judged.where("n > 1 or not stays").select(F.xxhash64("doc_id", "source").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_of"), "stays"))
    doc_id, source = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    told = flagged(docs.withColumn("_row", F.xxhash64(doc_id, source)), "_row", known, "_maybe")
    plain = told.where(~F.col("_maybe") | doc_id.isNull()).select(*docs.columns)
    maybe = told.where(F.col("_maybe") & doc_id.isNotNull()).select(*docs.columns)
    gone = known.where("not stays")
    left = maybe.join(gone, (maybe["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(maybe["text"].cast("string")) == gone["_of"]), "left_anti")
    release(spark)
    return plain.unionByName(left.dropDuplicates(["doc_id", "text"]))
