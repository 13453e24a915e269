"""Which texts hold which items, whatever their case (T11), by hash joins on words that an item must share with its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: str) -> Column:
    """The words of a text in lower case, as white space parts them; the two small sigmas are one."""
    return F.filter(F.split(F.translate(F.lower(text), "ς", "σ"), r"\s+"), lambda w: w != "")


def holders(texts: DataFrame, items: DataFrame, text_key: str, item_key: str) -> DataFrame:
    """text_key, item_key, text and item of every text that holds an item, in any case. texts: key, text; items: key, item; keys are unique.

    All words of an item but the first and the last stand in its text as whole words. So a long item meets its texts at three of
    them in a row (those with the most letters), one of three or four words at its longest inner word, and the pairs that met are
    looked at. One or two words may be part of others: they are held against the vocabulary, not against texts. Blank items
    aren't looked for; null texts hold none.
    """
    parts = items.withColumn("_w", _words("item")).where(F.size("_w") > 0)
    inner = F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))
    longest = lambda a: F.array_max(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    threes = lambda a: F.when(F.size(a) >= 3, F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: F.array_join(F.slice(a, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    rows = texts.select(text_key, _words("text").alias("_words"))
    three = parts.where(F.size("_w") >= 5).select(item_key, longest(threes(inner)).alias("_at"))
    one = parts.where(F.size("_w").isin(3, 4)).select(item_key, longest(inner).alias("_at"))
    few = parts.where(F.size("_w") < 3).select(item_key, F.col("_w")[0].alias("_first"), (F.size("_w") == 2).alias("_two"))
    words = rows.select(text_key, F.explode(F.array_distinct("_words")).alias("_at"))
    known = words.select("_at").distinct().join(few, F.when(F.col("_two"), F.endswith("_at", "_first")).otherwise(F.contains("_at", "_first"))).select(item_key, "_at")
    met = rows.select(text_key, F.explode(F.array_distinct(threes(F.col("_words")))).alias("_at")).join(three, "_at").select(text_key, item_key)
    met = met.union(words.join(one.union(known), "_at").select(text_key, item_key)).distinct()
    both = met.join(items.select(item_key, "item"), item_key).join(texts.select(text_key, "text"), text_key)
    return both.where(F.contains(F.lower("text"), F.lower("item")) | F.contains("text", "item")).select(text_key, item_key, "text", "item")
