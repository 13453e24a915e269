"""The registered queries and their SQL.

The driver's tables stand in for a directory: a fixture is SQL that both engines run, so a query and its oracle read the
same rows and differ in everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Relations in SQL alone, which the SQL of a query may name; Spark has its own way to them.
SQL_ONLY: dict[str, str] = {}


#: Fixtures that Spark makes in a way of its own, with the rows of their SQL.
BUILT: dict[str, Callable[[Tables], DataFrame]] = {}


class Tables:
    """The driver's tables and the fixtures over them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BUILT:
            return BUILT[name](self)
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Runs SQL whose {names} are tables or fixtures."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def _names(text: str) -> list[str]:
    from string import Formatter

    return sorted({n for _, n, _, _ in Formatter().parse(text) if n})


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables; sql may name fixtures and tables in braces."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[function.__name__] = expanded(sql)
        return function

    return register


def expanded(sql: str) -> str:
    """The SQL with its fixtures as common table expressions before it."""
    order: list[str] = []
    known = {**FIXTURES, **SQL_ONLY}

    def visit(text: str) -> None:
        for n in _names(text):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(sql)
    body = sql.format(**{n: n for n in _names(sql)}).strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({known[n].format(**{m: m for m in _names(known[n])}).strip()})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


#: Rows of a directory from the driver's tables, by whole-number arithmetic that both engines share.
FIXTURES: dict[str, str] = {
    "places": """
SELECT c_custkey AS place_id,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 97 = 5 THEN 'Sisters of ' || c_mktsegment ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ' ' WHEN c_custkey % 7 = 2 THEN 'Oak  Plaza' ELSE CAST(c_custkey % 90 AS STRING) || ' Main  St' END AS address,
  n_name AS city, 'S' || CAST(n_regionkey AS STRING) AS state, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(90000 + c_custkey % 50 AS STRING) END AS zip_code,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(30 * 64 + (c_custkey * 37) % 640 AS DOUBLE) / 64 END AS latitude,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 91) % 1280 AS DOUBLE) / 64 - 125 END AS longitude,
  CASE WHEN c_custkey % 3 = 0 THEN 'http://www.place' || CAST(c_custkey AS STRING) || '.org/' END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN '(555) 010-' || CAST(1000 + c_custkey % 9000 AS STRING) END AS phone,
  CASE WHEN c_custkey % 29 = 0 THEN 'found' WHEN c_custkey % 6 = 0 THEN NULL ELSE 'osm' END AS source,
  CASE WHEN c_custkey % 29 = 0 THEN 'C-' || CAST(c_custkey AS STRING) END AS external_id,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS denomination,
  c_custkey % 2 = 0 AS has_google_address,
  CASE c_custkey % 10 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'in_scope_labeled' WHEN 2 THEN 'in_scope' END AS scope_status,
  CASE WHEN c_custkey % 4 = 1 THEN 'About us' END AS summary,
  CASE WHEN c_custkey % 6 = 1 THEN 'Sun 10am' WHEN c_custkey % 6 = 2 THEN '  ' END AS service_times,
  CASE c_custkey % 8 WHEN 0 THEN 'Mandarin;English' WHEN 1 THEN ' english ; Korean' WHEN 2 THEN '' END AS service_languages,
  CASE WHEN c_custkey % 13 = 0 THEN 'Kids' END AS kids_program,
  CASE c_custkey % 12 WHEN 0 THEN '{{"worship_style": "Modern", "service_languages": ["Spanish", "Korean"], "programs": ["Youth night"]}}'
    WHEN 1 THEN '{{"worship_style": "", "programs": "none"}}' WHEN 2 THEN '{{"theological_stance": "Moderate", "programs": []}}'
    WHEN 3 THEN '{{"statement_of_faith": ["x"], "service_languages": "English"}}' WHEN 4 THEN 'not json' END AS tags
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "reviews": """
SELECT o_orderkey AS review_id, o_custkey AS place_id, CAST(1 + o_orderkey % 5 AS DOUBLE) AS rating,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(3 + o_orderkey % 3 AS DOUBLE) END AS childrens_programs,
  CAST(1 + (o_orderkey * 7) % 5 AS DOUBLE) AS sermon_depth, o_orderdate AS created_at
FROM {orders}""",
    "programs": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS place_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'weekday_care' ELSE 'sunday' END AS program_type, l_linenumber % 5 AS band
FROM {lineitem}""",
    "artifacts": """
SELECT event_id AS artifact_id, user_id AS subject_id, event_type AS kind, ts AS seen_at, event_id % 4 <> 0 AS ok,
  CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' ELSE 'ok' END AS status
FROM {events}""",
}
