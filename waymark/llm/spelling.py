"""Operator 11: spelling variants of words, by k-d trees over their letter counts.

Words are counted over all texts. A word's vector says how often each letter is in it. One edit changes it by at most one
letter more and one less: of words of one length by one each (or none, if the letters share a slot), of the longer of two
words by one more and none less. So there is a tree for each length, and each word searches the trees of its own length and
of the next, with boxes pruned by how many letters they must have more or less than the word. What is left is verified letter
by letter.

A tree has two levels. Its upper cuts, fitted on a sample, divide the words of a length into leaves; each word goes to its
leaf as an entry, and as a query to each leaf that its box reaches. They say where the work is done, never what is found.
Within a leaf the entries get a k-d tree with tight boxes, and the queries stream past it. A leaf with more entries than a
task should hold (words of the same letters can't be cut apart) is dealt to several, and its queries go to all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import map_rows, powers, settle, tuned

#: Code points of a word at least, its occurrences at least, and how many times as frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: One run in so many (by its hash) has a code point deleted.
DELETED = 31
#: Words that the upper cuts are fitted on, and entries of a leaf that they aim at; a task holds so many entries at most.
SAMPLE, LEAF, MOST = 100_000, 16_384, 65_536
#: Entries of a leaf of the tree within a task.
SMALL = 16
#: Slots of a vector: a letter each for a to z, the others by their code point.
SLOTS = 32
#: Words that a worker counts before it passes them on.
HELD = 1 << 18

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
#: Runs of a-z and of the two-byte UTF-8 forms of U+00C0 to U+00FF, after A-Z are lower.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_SLOT = np.array([k - 97 if 97 <= k < 123 else 26 + k % (SLOTS - 26) for k in range(256)])


def words_of(text: bytes, doc_id: bytes) -> Counter[bytes]:
    """How often each result of at least LENGTH code points occurs in a UTF-8 text: its runs, some with a code point deleted."""
    out: Counter[bytes] = Counter()
    begun = zlib.crc32(doc_id + b":")
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        if len(run) < LENGTH:
            continue
        h = zlib.crc32(run, begun)
        if h % DELETED == 0:
            letters = run.decode()
            k = h % len(letters)
            letters = letters[:k] + letters[k + 1 :]
            run = letters.encode()
        if len(run) - run.count(b"\xc3") >= LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of all words of the documents."""
    tuned(docs.sparkSession)

    def packed(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for text, doc_id in zip(b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary()), strict=True):
                held.update(words_of(text.as_py(), doc_id.as_py()))
                if len(held) >= HELD:
                    yield packed(held)
                    held.clear()
        if held:
            yield packed(held)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")).where("text is not null")
    return rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def vectors(words: list[str]) -> np.ndarray:
    """The letter counts of each word; counts over 127 as 127, which brings no two words further apart."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.minimum(np.bincount(owner * SLOTS + _SLOT[codes], minlength=len(words) * SLOTS), 127).astype(np.int16).reshape(-1, SLOTS)


class Tree:
    """A k-d tree of vectors. A node's box holds all its entries; with cells, the boxes of the leaves divide the whole space."""

    def __init__(self, entries: np.ndarray, most: int, cells: bool = False):
        every = np.full(SLOTS, -1, np.int16), np.full(SLOTS, 128, np.int16)
        low, high, left, self.members = [], [], [], []
        waiting = [(np.arange(len(entries)), *every)]
        at = 0
        while at < len(waiting):
            own, least, greatest = waiting[at]
            at += 1
            x = entries[own]
            if not cells and len(own):
                least, greatest = x.min(0), x.max(0)
            low.append(least)
            high.append(greatest)
            spread = x.var(0) if len(own) > most else np.zeros(SLOTS)
            if not spread.any():
                left.append(-1)
                self.members.append(own)
                continue
            k = int(spread.argmax())
            cut = min(int(np.median(x[:, k])), int(x[:, k].max()) - 1)
            up, down = greatest.copy(), least.copy()
            up[k], down[k] = cut, cut + 1
            left.append(len(waiting))
            self.members.append(own[:0])
            waiting += [(own[x[:, k] <= cut], least, up), (own[x[:, k] > cut], down, greatest)]
            waiting[at - 1] = (own[:0], least, greatest)
        self.low, self.high, self.left = np.array(low), np.array(high), np.array(left)

    def reach(self, queries: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves with room for a vector that has up to `more` letters more and up to `less` fewer than the query."""
        who, at = np.arange(len(queries)), np.zeros(len(queries), int)
        found = []
        while len(who):
            q = queries[who]
            near = (np.maximum(self.low[at] - q, 0).sum(1) <= more) & (np.maximum(q - self.high[at], 0).sum(1) <= less)
            who, at = who[near], at[near]
            ends = self.left[at] < 0
            found.append((who[ends], at[ends]))
            following = self.left[at[~ends]]
            who, at = np.repeat(who[~ends], 2), np.column_stack((following, following + 1)).ravel()
        return np.concatenate([w for w, _ in found]), np.concatenate([a for _, a in found])


def _cuts(words: DataFrame) -> dict[int, Tree]:
    """For each length with more words than a leaf should have (as the sample says), the upper cuts."""
    total = words.count()
    every = max(1, -(-total // SAMPLE))
    found: dict[int, list[str]] = {}
    for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").collect():
        found.setdefault(len(r["word"]), []).append(r["word"])
    return {k: Tree(vectors(v), max(1, LEAF // every), cells=True) for k, v in found.items() if len(v) * every > LEAF}


def _routed(words: DataFrame) -> DataFrame:
    """size, leaf, turn (0 an entry, 1 a query), word and n: where each word is kept, and where it searches."""
    cuts = _cuts(words)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(0).to_pylist()
        sizes = np.array([len(w) for w in found])
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            q = vectors([found[i] for i in own])
            for tree_of, turn, more, less in ((size, 0, 0, 0), (size, 1, 1, 1), (size + 1, 1, 1, 0)):
                tree = cuts.get(tree_of)
                who, leaf = (np.arange(len(own)), np.zeros(len(own), int)) if tree is None else tree.reach(q, more, less)
                parts.append((own[who], np.full(len(who), tree_of), leaf, turn))
        who = pa.array(np.concatenate([p[0] for p in parts]))
        columns = [pa.array(np.concatenate([p[1] for p in parts]), pa.int32()), pa.array(np.concatenate([p[2] for p in parts]), pa.int32())]
        columns += [pa.array(np.concatenate([np.full(len(p[0]), p[3]) for p in parts]), pa.int32()), batch.column(0).take(who), batch.column(1).take(who)]
        return pa.RecordBatch.from_arrays(columns, ["size", "leaf", "turn", "word", "n"])

    return map_rows(words.select("word", "n"), work, "size int, leaf int, turn int, word string, n long")


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _halves(letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the first letters of each row, half of `size`, and one of as many last letters as the other half has."""
    half = size // 2
    values = letters.astype(np.uint64) + np.uint64(1)
    return values[:, :half] @ powers(half + 1)[1:], values[:, letters.shape[1] - size + half :] @ powers(size - half + 1)[1:]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters become those of b, which are as long or longer by one, by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


class _Leaf:
    """The entries of a leaf, and the search of queries among them."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.entries, self.letters = vectors(words), _letters(words)
        self.tree = Tree(self.entries, SMALL)
        self.halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) for all that are one edit apart; of two words of the same length, with the smaller as the query."""
        q, letters, size = vectors(queries), _letters(queries), len(queries[0])
        less = int(size == len(self.words[0]))
        who, leaf = self.tree.reach(q, 1, less)
        sizes = np.array([len(self.tree.members[k]) for k in leaf], int)
        who = np.repeat(who, sizes)
        what = np.concatenate([self.tree.members[k] for k in leaf]) if len(leaf) else who
        # One edit leaves the letters before the middle of the query or those after it; few others have one of both.
        if size not in self.halves:
            self.halves[size] = _halves(self.letters, size)
        (head, tail), (other_head, other_tail) = _halves(letters, size), self.halves[size]
        fits = (head[who] == other_head[what]) | (tail[who] == other_tail[what])
        who, what = who[fits], what[fits]
        fits = _one_edit(letters[who], self.letters[what])
        who, what = who[fits], what[fits]
        if less:
            fits = np.array([queries[i] < self.words[k] for i, k in zip(who.tolist(), what.tolist(), strict=True)], bool)
            who, what = who[fits], what[fits]
        return who, what


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other and other_n, for all words (word, n) that are one edit apart, both ways."""
    routed = settle(_routed(words))
    parts = settle(routed.where("turn = 0").groupBy("size", "leaf").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("parts")))
    there = routed.join(parts, ["size", "leaf"])
    own = F.array(F.pmod(F.xxhash64("word"), "parts").cast("int"))
    dealt = there.withColumn("part", F.explode(F.when(F.col("turn") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = dealt.repartition("size", "leaf", "part").sortWithinPartitions("size", "leaf", "part", "turn", F.length("word"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, leaf, words, counts = None, None, [], []
        for b in batches:
            turn, size = b.column(3).to_numpy(), pa.compute.utf8_length(b.column(4)).to_numpy()
            keys = np.column_stack((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), turn, size))
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                found, n = b.column(4)[i:j].to_pylist(), b.column(5)[i:j].to_numpy()
                if tuple(keys[i, :3]) != where:
                    where, leaf, words, counts = tuple(keys[i, :3]), None, [], []
                if turn[i] == 0:
                    words += found
                    counts += n.tolist()
                    continue
                if not words:
                    continue
                leaf = leaf or _Leaf(words, counts)
                who, what = leaf.near(found)
                if len(who):
                    a, b_ = [found[k] for k in who], [leaf.words[k] for k in what]
                    m = np.concatenate((n[who], leaf.counts[what])), np.concatenate((leaf.counts[what], n[who]))
                    yield pa.RecordBatch.from_arrays([pa.array(a + b_, pa.string()), pa.array(m[0]), pa.array(b_ + a, pa.string()), pa.array(m[1])], ["word", "n", "other", "other_n"])

    rows = dealt.select("size", "leaf", "part", "turn", "word", "n")
    return rows.mapInArrow(search, "word string, n long, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form; every round follows twice as many. A form is TIMES as frequent, so chains are short."""
    roots = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = roots.join(further, F.col("root") == F.col("_word"), "left")
        if moved.where("_root is not null").isEmpty():
            return roots
        roots = settle(moved.select("word", F.coalesce("_root", "root").alias("root")))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    Null and empty texts have no words; a null id counts as an empty one. Rows that repeat count each time. Of equally frequent
    near words the smallest in code-point order is taken. Texts and words of any length are taken whole; an empty table gives
    no rows. Columns of other names aren't looked at.
    """
    words = settle(vocabulary(docs))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    known = settle(words.join(near, "word", "left"))
    has_form = -F.col("best.n") >= TIMES * F.col("n")
    forms = known.where(has_form).select("word", F.col("best.other").alias("form"))
    out = known.join(_roots(forms), "word", "left")
    return out.select("word", F.when(has_form, F.col("best.other")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, -F.col("best.n")).alias("form_n"))
