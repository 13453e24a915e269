"""Files in and out: delimited text, archives of records, documents with fenced blocks, paired outputs."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A CSV with a header and declared columns; None if there is no such path."""
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in this order, others left out, with a header in each file."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def piped_text(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Lines of |-separated Latin-1 text; lines with fewer fields than columns are left out."""
    # The text reader knows UTF-8 alone; a CSV without quotes whose separator no text has is lines in any encoding.
    lines = spark.read.schema("value string").option("sep", "\x01").option("quote", "").option("encoding", "ISO-8859-1").csv(path)
    parts = lines.select(F.split("value", r"\|").alias("p")).where(F.size("p") >= len(columns))
    out = parts.select(*[F.btrim(F.col("p")[k]).alias(c) for k, c in enumerate(columns)])
    return out if where is None else out.where(where)


def dbf_rows(data: bytes) -> Iterator[dict[str, str]]:
    """The rows of a dBase table as texts; rows that are marked as deleted are left out."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at, offset = [], 32, 1
    while data[at] != 0x0D:
        length = data[at + 16]
        fields.append((data[at : at + 11].split(b"\x00")[0].decode("ascii"), offset, length))
        at, offset = at + 32, offset + length
    for k in range(count):
        row = data[head + k * size : head + (k + 1) * size]
        if len(row) == size and row[:1] != b"*":
            yield {name: row[a : a + n].decode("latin-1").strip() for name, a, n in fields}


def zipped_dbf(spark: SparkSession, path: str) -> DataFrame:
    """Path, member and fields (a map of texts) of every row of the .dbf members of the zip files under a path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.namelist():
                        if member.lower().endswith(".dbf"):
                            rows = [(name, member, list(r.items())) for r in dbf_rows(z.read(member))]
                            for i in range(0, len(rows), 5000):
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000], strict=True), kinds, strict=True)], ["path", "member", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "path string, member string, fields map<string,string>")


def fenced_blocks(spark: SparkSession, path: str, language: str = "json") -> DataFrame:
    """Path, place and block of every fenced block of a language in the text files under a path."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.regexp_extract_all("value", F.lit(rf"(?s)```{language}[ \t]*\r?\n(.*?)\r?\n?```"), 1)
    return docs.select("path", F.posexplode(found).alias("place", "block"))


def copied_whole(source: DataFrame, target: DataFrame, exact_to: int = 1000, tolerance: float = 0.001) -> DataFrame:
    """One row, both counts and whether they agree: exactly for small tables, else within the tolerance."""
    n = source.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(target.agg(F.count(F.lit(1)).alias("target_rows")))  # one row each
    gap = F.abs(F.col("source_rows") - F.col("target_rows"))
    return n.withColumn("agrees", F.when(F.col("source_rows") <= exact_to, gap == 0).otherwise(gap <= tolerance * F.col("source_rows")))


def write_with_receipt(df: DataFrame, path: str, inputs_digest: str) -> None:
    """The rows, and beside them a receipt with their number, their digest and the digest of what they were made from."""
    from waymark.operators.quality import table_digest

    df.write.mode("errorifexists").parquet(f"{path}/rows")
    receipt = table_digest(df.sparkSession.read.parquet(f"{path}/rows")).withColumn("inputs", F.lit(inputs_digest))
    receipt.coalesce(1).write.mode("errorifexists").json(f"{path}/receipt")


def bound_rows(spark: SparkSession, path: str, inputs_digest: str) -> DataFrame:
    """Rows written with a receipt, none of them if they were made from other inputs than these."""
    rows, receipt = spark.read.parquet(f"{path}/rows"), spark.read.schema("inputs string").json(f"{path}/receipt")
    return rows.join(F.broadcast(receipt.where(F.col("inputs") == inputs_digest).select(F.lit(1).alias("_bound"))), F.lit(True), "left_semi")  # one row
