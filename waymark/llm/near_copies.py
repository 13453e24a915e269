"""Operator 7 on word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come the fingerprints of operator 7, made from the shingles: multi-index hashing fetches those within two bits, and the
sets' similarity is verified. But sets that are 0.8 alike differ in about ten bits of 64, more than balls within segments can
enumerate. So what fingerprints leave apart goes through an exact join of the same sets by prefix filtering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import simhash
from waymark.llm.common import join_hot, release, settle_narrow
from waymark.llm.ngram_join import Likeness, component_ids, links

#: Five-word shingles, alike at 0.8.
ALIKE = Likeness(5, 4, 5)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of nodes (node, fp): those with one fingerprint meet the smallest of them, and these meet over operator 7's links."""
    first = settle_narrow(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")))
    same = join_hot(nodes.select("fp", "node"), settle_narrow(first.where("rows > 1")), "fp", "rows", how="inner").select("node", "first")
    met = settle_narrow(simhash.links(first.select("fp")))
    release(nodes.sparkSession)
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}"))
    return _pairs(same, "node", "first").union(_pairs(met.join(of("a"), "a").join(of("b"), "b"), "first_a", "first_b"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group of near copies, with all their columns.

    A group is what is connected by alike pairs; texts without a word (null, empty) are a group. Of rows of one group with
    its smallest id one text stays, and a row repeated with its id and text stays once; a row whose id is first in another
    group goes all the same. Rows without an id stay. An empty table gives none. Texts of any length are compared whole.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, linked = links(texts, ALIKE, by_fingerprint)
    return simhash.first_of_each(docs, component_ids(rows.withColumn("node", F.coalesce("node", F.lit(0))), linked))
