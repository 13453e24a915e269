"""Texts for a model within budgets of characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a page at most, and of all pages together; parts in which a subject's pages are cut before they come together.
PAGE, TOTAL, PARTS = 8_000, 24_000, 64


def within_budget(pages: DataFrame, key: str, order: Sequence[str], page: int = PAGE, total: int = TOTAL) -> DataFrame:
    """The pages of each subject that fit, numbered from 1 in their order (nth), their text cut where the budget ends.

    A page gives its first `page` characters at most; the page at which `total` is reached is cut there and the rest left out.
    Null and blank texts are no pages. A subject with very many pages is cut in parts first: what stands behind a full budget
    of its own part stands behind it among all, so few pages of it come together. The order should tell all pages apart.
    """
    rows = pages.where("btrim(coalesce(text, '')) <> ''").withColumn("_size", F.least(F.length("text"), F.lit(page)).cast("long")).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))

    def before(*by: str):
        return F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    near = rows.withColumn("_used", before(key, "_part")).where(F.col("_used") < total)
    kept = near.withColumn("_used", before(key)).where(F.col("_used") < total)
    cut = F.substring("text", F.lit(1), F.least(F.col("_size"), total - F.col("_used")).cast("int"))
    return kept.withColumns({"nth": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "text": cut}).select(*pages.columns, "nth")


def model_input(pages: DataFrame, key: str, order: Sequence[str], page: int = PAGE, total: int = TOTAL) -> DataFrame:
    """Key and input: the pages of within_budget(), each under a line with its number, kind and url. pages: key, kind, url, text."""
    part = F.concat(F.lit("=== PAGE "), F.col("nth").cast("string"), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(") "), F.coalesce("url", F.lit("")), F.lit(" ===\n"), "text")
    rows = within_budget(pages, key, order, page, total).select(key, F.struct("nth", part.alias("part")).alias("p"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("input"))


def headed_text(pages: DataFrame, key: str, order: Sequence[str], most: int = 18_000) -> DataFrame:
    """Key and input: all pages in order, each under its kind, cut after so many characters with a mark. pages: key, kind, text."""
    trimmed = pages.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("text", F.concat(F.lit("# "), F.coalesce("kind", F.lit("")), F.lit("\n"), "text"))
    # Two characters between pages; one character over the limit tells whether there was more.
    spaced = trimmed.withColumn("text", F.concat("text", F.lit("\n\n")))
    rows = within_budget(spaced, key, order, most + 3, most + 3).select(key, F.struct("nth", "text").alias("p"))
    whole = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("input"))
    plain = F.regexp_replace("input", "\n\n$", "")
    cut = F.length(plain) > most
    return whole.select(key, F.when(cut, F.concat(F.substring("input", 1, most), F.lit("\n\n[...truncated]"))).otherwise(plain).alias("input"))
