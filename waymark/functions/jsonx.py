"""Column expressions for JSON text, arrays and lists (F10-F13, R1-R11): a wrong shape is no match, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(column: Column | str, key: str) -> Column:
    """A field of a JSON object as text, null if it isn't there or the text is no object."""
    return F.get_json_object(column, f"$.{key}")


def filled_array(column: Column | str, key: str) -> Column:
    """whether a field is an array with elements."""
    return F.coalesce(F.json_array_length(at(column, key)) > 0, F.lit(False))


def folded_equal(column: Column | str, key: str, value: str) -> Column:
    """whether a field equals a text without regard to case."""
    return F.coalesce(F.lower(at(column, key)) == F.lower(F.lit(value)), F.lit(False))


def strings(column: Column | str, key: str) -> Column:
    """The text elements of a field that is an array; no elements otherwise."""
    raw = F.when(filled_array(column, key), F.from_json(at(column, key), "array<string>"))
    return F.coalesce(F.filter(raw, lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)"))


def overlaps(column: Column | str, values: Sequence[str]) -> Column:
    """whether an array holds one of the values; null elements match nothing."""
    wanted = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.exists(column, lambda x: F.array_contains(wanted, x)), F.lit(False))


def explode_list(df: DataFrame, column: str, name: str, separator: str = ";") -> DataFrame:
    """A row for each part of a list in text, trimmed, empty parts left out."""
    return df.withColumn(name, F.explode(F.split(column, separator))).withColumn(name, F.btrim(name)).where(F.col(name) != "")


def first_mentions(*arrays: Column) -> Column:
    """The elements of several arrays, each once, in order of first mention."""
    return F.array_distinct(F.concat(*arrays))


def in_fixed_order(column: Column, order: Sequence[str]) -> Column:
    """An array's elements in the order of a fixed list, others left out."""
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(column, x))


def first_object(column: Column | str) -> Column:
    """The text from the first { to the last }, if that is JSON."""
    found = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def fill_blank(column: Column | str, value: Column) -> Column:
    """The value where the column is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), value)


def one_of(column: Column, allowed: Sequence[str], default: str | None = None) -> Column:
    """A value of a fixed set in its own spelling, or the default."""
    return F.coalesce(F.when(F.lower(F.btrim(column)).isin(*allowed), F.lower(F.btrim(column))), F.lit(default))


def within(column: Column, low: float, high: float) -> Column:
    """A number cut off at both ends; what is no number is null."""
    return F.least(F.lit(high), F.greatest(F.lit(low), column.try_cast("double"))) if low is not None else column
