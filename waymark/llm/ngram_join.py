"""Operator 13: texts whose sets of word n-grams have at least a given Jaccard similarity, by rare-first prefix filtering.

Every n-gram has a key that begins with the class of its frequency, so ascending keys are one order of all n-grams, rare
first. The frequencies are counted over all texts in a table of fixed size by hash; they decide how many candidates there
are, never which links are found. Equal sets are one node. Then:

- prefix: two alike sets have a key in common among the first (1 - t) * n + 1 of each, t being the least similarity. Only
  keys that several nodes have there are joined.
- length: the smaller set has t times the size of the larger one at least.
- positional: all common keys up to where one prefix ends are counted; what is behind can add no more than is left of either.
- suffix: what is left is counted by ranges of the hash; of each range two sets share no more than the smaller count.
- what passes is verified by the whole sets, once for each pair.

In the first rounds each node meets one other: at each of its keys there is the node where that key comes first, which has
the fewest keys of its own and so is the likely original of a group of copies, and of these the one at most keys is taken.
Last, all pairs of nodes that share a key and are still in different components meet. So no link between components is
lost, and a group of many near copies makes no square of pairs. Verification brings the texts of a pair's ends together,
the hub's first; a hub with many pairs is split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import simhash
from waymark.llm.common import blocks, gram_hashes, join_hot, map_rows, may_match, mix, release, run_hashes, settle, settle_narrow, tuned
from waymark.operators.matching import components

#: Slots of the table of frequencies, and how many of them one row holds.
SLOTS, CHUNK = 1 << 21, 1 << 13
#: Bits of a key below the class of its frequency.
HASH_BITS = 57
#: Ranges of the hash in which the rest of a set is counted.
RANGES = 32
#: Pairs of a hub that are verified beside one copy of its text.
PAIRS_A_HUB = 256
#: Rounds in which nodes meet one other before all that are still apart meet. It doesn't change the result.
MEETINGS = 2

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Likeness:
    """Sets of n-grams of so many words are alike if their Jaccard similarity is at least part / whole."""

    words: int = 4
    part: int = 85
    whole: int = 100

    def fits(self, common: Column, sizes: Column) -> Column:
        """Whether so many in common are enough for sets with this sum of sizes."""
        return common * (self.part + self.whole) >= sizes * self.part

    def near(self, a: Column, b: Column) -> Column:
        """The length filter."""
        return F.least(a, b) * self.whole >= F.greatest(a, b) * self.part

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1 if n else 0


def shingles(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of the column's texts: the hashes of all their n-grams, and how many each text has; of fewer words, one of all."""
    for _, _, block in blocks(column):
        data = _LOWER[block.data]
        begins, ends = block.runs(_WORD[data])
        n = np.bincount(np.searchsorted(block.offsets, begins, side="right") - 1, minlength=len(block))
        hashes = run_hashes(data, begins, ends)
        grams = gram_hashes(hashes, words)
        out, at = [], 0
        for m in n.tolist():
            out.append(grams[at : at + m - words + 1] if m >= words else gram_hashes(hashes[at : at + m], m) if m else hashes[:0])
            at += m
        yield np.concatenate(out), np.where(n >= words, n - words + 1, np.minimum(n, 1))


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The hashes of each text's distinct n-grams, ascending."""
    return [np.unique(s) for grams, counts in shingles(column, words) for s in np.split(grams, np.cumsum(counts)[:-1])]


def frequency_classes(texts: DataFrame, like: Likeness) -> np.ndarray:
    """For each slot, by the hash's first bits, twice the binary logarithm of how many n-grams of all texts fell there."""
    tuned(texts.sparkSession)
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int32)
        for b in batches:
            found = _sets(b.column(0), like.words)
            if found:
                total += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=SLOTS).astype(np.int32)
        pa.default_memory_pool().release_unused()
        rows = [(k, at, total[k * CHUNK :][at]) for k in range(SLOTS // CHUNK) if len(at := np.flatnonzero(total[k * CHUNK : (k + 1) * CHUNK]))]
        for k, at, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.int32)]), pa.array([n])], ["chunk", "at", "n"])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                totals.setdefault(k, np.zeros(CHUNK, np.int64))[at.values.to_numpy()] += n.values.to_numpy()
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(2 * np.log2(np.maximum(total, 1)), 63).astype(np.uint8).tobytes()])], ["chunk", "classes"])

    rows = texts.select("text").mapInArrow(counted, "chunk int, at array<int>, n array<int>").repartition("chunk").mapInArrow(classed, "chunk int, classes binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in rows.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["classes"]), np.uint8)
    return out


def _kept(df: DataFrame) -> DataFrame:
    """settle_narrow(), and the shuffles that led there go: with many partitions even small ones take room on disk."""
    out = settle_narrow(df)
    release(df.sparkSession)
    return out


def _node(found: np.ndarray) -> int | None:
    """A hash of a set of keys; null for the empty set."""
    return int(mix(mix(found).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))).view(np.int64)[0]) if len(found) else None


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def heads(texts: DataFrame, like: Likeness, prints: bool = False) -> DataFrame:
    """doc_id, source (a hash of the text), node, n, head (the prefix), rest (counts of what is behind it, by range) of every row; with prints, fp."""
    classes = frequency_classes(texts, like)
    shift, low = np.uint64(64 - (SLOTS.bit_length() - 1)), np.uint64((1 << HASH_BITS) - 1)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, fps = [], []
        for grams, counts in shingles(batch.column(2), like.words):
            keys = classes[(grams >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS) | grams & low
            found += map(np.unique, np.split(keys, np.cumsum(counts)[:-1]))
            if prints:
                fps.append(simhash.majority(grams, counts))
        ends = [like.prefix(len(s)) for s in found]
        rest = [np.bincount((s[p:] >> np.uint64(20)).astype(np.int64) % RANGES, minlength=RANGES) for s, p in zip(found, ends, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array([_node(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())]
        columns += [_lists([s[:p] for s, p in zip(found, ends, strict=True)], np.int64), _lists(rest, np.int32)]
        columns += [pa.array(np.concatenate(fps).view(np.int64))] if prints else []
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    schema = "doc_id long, source long, node long, n long, head array<long>, rest array<int>" + ", fp long" * prints
    return map_rows(texts.select("doc_id", F.xxhash64("text").alias("source"), "text"), work, schema)


def _fitting(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of nodes that pass the positional and the suffix filter."""
    of = lambda end: nodes.select(*[F.col(c).alias(end if c == "node" else f"{end}_{c}") for c in ("node", "n", "head", "rest")])
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    # Up to the key where the first of the prefixes ends, all that is common is in both; of the other prefix, some is behind it.
    stop = F.least(F.element_at("a_head", -1), F.element_at("b_head", -1))
    passed = lambda end: F.size(F.filter(f"{end}_head", lambda g: g <= F.col("stop")))
    both = both.withColumn("stop", stop).withColumns({"k": F.size(F.array_intersect("a_head", "b_head")), "a_at": passed("a"), "b_at": passed("b")})
    over = F.greatest(F.size("a_head") - F.col("a_at"), F.size("b_head") - F.col("b_at"))
    shared = F.aggregate(F.zip_with("a_rest", "b_rest", lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    bound = F.col("k") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"), shared + over)
    return both.where(like.fits(bound, F.col("a_n") + F.col("b_n"))).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; b is the hub. Only the texts of these nodes are moved."""
    source = lambda end: nodes.select(F.col("node").alias(end), F.col("source").alias(f"{end}_source"))
    pairs = _kept(pairs.select("a", "b").join(source("a"), "a").join(source("b"), "b"))
    hubs = _kept(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"), F.first("b_source").alias("source")).withColumn("parts", F.ceil(F.col("rows") / PAIRS_A_HUB).cast("int")))
    member = join_hot(pairs, hubs.select("b", "rows", "parts"), "b", "rows", how="inner").select(F.col("a_source").alias("source"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.col("a").alias("node"), F.lit(1).alias("turn"))
    hub = hubs.select("source", F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"), F.lit(0).alias("turn"))
    ways = _kept(member.union(hub))
    wanted = may_match(texts.select(F.xxhash64("text").alias("source"), "text"), "source", ways).dropDuplicates(["source"])
    moved = wanted.join(ways.hint("shuffle_hash"), "source").repartition("hub", "part").sortWithinPartitions("hub", "part", "turn").select("hub", "node", "turn", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int]] = []
            for hub, node, turn, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _sets(b.column(3), like.words), strict=True):
                if turn == 0:
                    own = found
                elif (like.part + like.whole) * len(np.intersect1d(own, found, assume_unique=True)) >= like.part * (len(own) + len(found)):
                    out.append((node, hub))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out], pa.int64()), pa.array([v[1] for v in out], pa.int64())], ["a", "b"])
        pa.default_memory_pool().release_unused()

    return moved.mapInArrow(compared, "a long, b long")


def _rooted(rows: DataFrame, label: DataFrame, key: str = "node", name: str = "root") -> DataFrame:
    """rows with the root of the component of its node; of a node that nothing links to, itself."""
    known = label.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(known, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", key)).drop("_node", "_root")


def _apart(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """Of the keys whose nodes are in several components, all rows (g, node, n, pos, root), how many each key has (size), and y, the node to meet: where the key comes first."""
    rooted = shared.withColumn("root", F.col("node")) if label is None else _kept(_rooted(shared, label))
    groups = rooted.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("pos", F.xxhash64("node").alias("by"), "node", "n", "root")).alias("y"))
    groups = _kept(groups.where("low != high").select("g", "rows", F.col("rows").alias("size"), F.struct("y.node", "y.n", "y.root").alias("y")))
    return _kept(join_hot(may_match(rooted, "g", groups), groups, "g", "rows", how="inner"))


def links(texts: DataFrame, like: Likeness = Likeness(), first: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, node and n of every row of texts (doc_id, text), and pairs (a, b) of alike nodes that connect all that are alike.

    `first` may give pairs (a, b) of nodes by the SimHash of their n-grams (node, fp), to be verified before all others.
    """
    spark = texts.sparkSession
    found = settle(heads(texts, like, first is not None))
    rows = settle(found.select("doc_id", "source", "node", "n"))
    kept = ["source", "n", "head", "rest", *(["fp"] if first else [])]
    nodes = settle(found.where("node is not null").groupBy("node").agg(F.first(F.struct(*kept)).alias("s")).select("node", "s.*"))
    del found
    release(spark)
    places = nodes.select("node", "n", F.posexplode("head").alias("pos", "g"))
    counted = settle(places.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    shared = settle(join_hot(may_match(places, "g", counted), counted, "g", "rows", how="inner").select("g", "node", "n", "pos"))
    del places, counted
    release(spark)
    linked = tested = spark.createDataFrame([], "a long, b long")
    label = None
    if first is not None:
        tested = _kept(first(nodes.select("node", "fp")))
        linked = _kept(_verified(_fitting(tested, nodes, like), nodes, texts, like))
        label = _kept(components(linked))
        release(spark)
    for _ in range(MEETINGS):
        apart = _apart(shared, label)
        met = apart.where((F.col("root") != F.col("y.root")) & like.near(F.col("n"), F.col("y.n"))).groupBy(F.col("node").alias("a"), F.col("y.node").alias("b")).count()
        if label is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        # Of the nodes that it meets, the one at most keys.
        best = _kept(met.groupBy("a").agg(F.max(F.struct("count", "b")).alias("y")).select("a", "y.b"))
        new = _kept(_verified(_fitting(best, nodes, like), nodes, texts, like))
        tested, linked = tested.union(best), linked.union(new)
        label = _kept(components(linked))
        del apart, met, best, new
        release(spark)
    pairs = _between(_apart(shared, label), like)
    both = tested.union(tested.select("b", "a"))
    pairs = _kept(_fitting(pairs.join(both, ["a", "b"], "left_anti"), nodes, like))
    if not pairs.isEmpty():
        linked = settle_narrow(linked.union(_verified(pairs, nodes, texts, like)))
    del pairs, both, tested, shared, label
    release(spark)
    return rows, linked


def _between(apart: DataFrame, like: Likeness) -> DataFrame:
    """All pairs (a, b) that meet at a key and are in different components, by the length and positional filters, each once or a few times.

    At a key, a node has in common with any other no more than what stands behind, the key itself, and those keys before it
    at which nodes of different components meet: of the others before it, none is in a set that has this key in its prefix.
    So it is alike to sets up to a largest size only (reach), and the smaller node of a pair must reach the larger one's. Behind
    the prefixes there is no more in common than the larger set's rest, so two alike nodes share a number of keys at least;
    it's enough that they meet at one of the rarest, so many that the others of either are fewer than that (left). And at
    least one end of each pair isn't in the component of the key's first node.
    """
    of_node = Window.partitionBy("node")
    before = F.row_number().over(of_node.orderBy("pos")) - 1
    reach = F.floor((F.col("n") - F.col("pos") + before) * (like.part + like.whole) / like.part) - F.col("n")
    left = F.count(F.lit(1)).over(of_node) - F.row_number().over(of_node.orderBy("size", "g")) + 1
    rows = apart.select("g", "node", "n", "root", (F.col("root") == F.col("y.root")).alias("main"), reach.alias("reach"), left.alias("left"))
    small = rows.where("reach >= n").select("g", F.col("node").alias("a"), "n", F.col("root").alias("a_root"), F.col("main").alias("a_main"), "reach", F.col("left").alias("a_left"))
    large = rows.select("g", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("b_root"), F.col("main").alias("b_main"), F.col("reach").alias("b_reach"), F.col("left").alias("b_left"))
    fits = (F.col("a_root") != F.col("b_root")) & F.col("m").between(F.col("n"), F.col("reach")) & (F.col("n") <= F.col("b_reach")) & ((F.col("n") < F.col("m")) | (F.col("a") < F.col("b")))
    shared = F.ceil((F.col("n") + F.col("m")) * like.part / (like.part + like.whole)) - F.ceil(F.col("m") * like.part / like.whole) + 1
    fits = fits & (F.least("a_left", "b_left") >= shared)
    met = small.where("not a_main").join(large, "g").where(fits).union(small.where("a_main").join(large.where("not b_main"), "g").where(fits))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def component_ids(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, node and more) with component_id, the smallest doc_id that can be reached over the edges (a, b) between nodes.

    A row without a node is a component of its own, whose id is the row's.
    """
    groups = settle_narrow(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_rows")))
    label = settle_narrow(components(edges))
    rooted = settle_narrow(_rooted(groups, label))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle_narrow(rooted.join(least, "root").where("_rows > 1 or component_id is distinct from least").select("node", "_rows", "component_id"))
    # A node of one row that no other reaches needs no class: its id is its row's.
    return join_hot(rows, classes, "node", "_rows").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def jaccard_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id, the smallest doc_id that can be reached over links, of every row.

    Texts without a word (null, empty) have an empty set and are linked with nothing; a text of fewer words than an n-gram
    is one n-gram. Repeated rows and ids stay, and share a component if their sets do. Rows without an id get their
    component's, which is null if no row of it has one. Texts are taken whole, however long; sets are compared by hashes of 64
    bits. An empty table gives no rows. Columns of other names aren't looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, linked = links(texts, like)
    return component_ids(rows, linked).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
