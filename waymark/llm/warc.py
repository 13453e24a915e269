"""Operator 2: WARC archives, written and read by Spark, and assembly of the records of a capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Archives are written by
Spark's text writer, gzip-compressed, a few thousand captures to a file (one gzip member each: Spark has no writer that
begins a member for each record). They are read as a stream: Spark's text reader parts them where a record may begin, and
a record takes as many parts as its own length says. So no file is held whole; what must fit in a task is the largest
record. Assembly joins the three kinds through WARC-Concurrent-To and emits a nested row for each capture.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import ARROW_BYTES, discard, join_hot, settle, shared_folder, tuned

#: Payloads below this are never revisits: a revisit record would save nothing.
LEAST_REVISIT = 100
#: Captures in an archive file at most: a file is what one task reads.
FILE_CAPTURES = 2000
#: What a record begins with; the reader parts an archive at each.
_MARK = "WARC/1."
#: Hexadecimal digits of a digest that name its slot in the filter of repeated digests.
_SLOT_DIGITS = 6
#: Pages have no time of capture; the format asks for one.
NO_DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"


# Writing.


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and first_id: the page that this one's payload was first seen on.

    Of rows with equal payloads of at least `least` bytes the smallest page_id comes first; first_id is null for it, for
    smaller payloads and for rows without a page_id. Digests are grouped without the payloads. Only rows whose digest may
    be a repeated one, by a filter of fixed size, are joined to the groups and shuffled, and of these no group of very
    many pages. A corpus with more repeated payloads than the filter has slots shuffles more of its rows, to the same end.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    groups = rows.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = settle(groups.where("n > 1"))
    slotted = lambda df: df.withColumn("_slot", F.conv(F.substring("payload_digest", 1, _SLOT_DIGITS), 16, 10).cast("long")).withColumns({"_word": F.expr("_slot div 64"), "_bit": F.expr("cast(_slot % 64 as int)")})
    # 64 slots to a row: at most 16 ** _SLOT_DIGITS / 64 rows of two longs, whatever the table's size.
    repeated = F.broadcast(slotted(groups).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    seen = slotted(rows).join(repeated, "_word", "left")
    may_repeat = F.coalesce(F.bit_get("_bits", "_bit") == 1, F.lit(False))
    once = seen.where(~may_repeat).select(*rows.columns, F.lit(None).cast("long").alias("first_id"))
    joined = join_hot(slotted(rows).join(repeated, "_word").where(may_repeat).select(*rows.columns), groups, "payload_digest", "n")
    return once.unionByName(joined.withColumn("first_id", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id"))))


def _record_id(page_id: Column, digest: Column, part: str = "") -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(digest, 1, 32), F.lit(part), F.lit(">"))


def _record(fields: list[Column], block: Column) -> Column:
    """A record's head and block; a field that is null is left out."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *fields, length), F.lit(_END), block)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def capture_text(date: str = NO_DATE) -> Column:
    """The three records of a row of with_revisits, as one text without the last record's end."""
    page, digest = F.col("page_id"), F.col("payload_digest")
    own, first = _record_id(page, digest), F.col("first_id").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    common = [_field("WARC-Target-URI", uri), F.lit(f"WARC-Date: {date}")]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    request = _record(
        [F.lit("WARC-Type: request"), _field("WARC-Record-ID", _record_id(page, digest, ":request")), _field("WARC-Concurrent-To", own), *common, F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1"), F.lit(_END)),
    )
    response = _record(
        [
            F.when(first, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")), _field("WARC-Record-ID", own), *common, _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            F.when(first, _field("WARC-Refers-To", _record_id(F.col("first_id"), digest))), F.when(first, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("Content-Type: application/http; msgtype=response"),
        ],
        F.when(first, head).otherwise(F.concat(head, F.col("payload"))),
    )
    metadata = _record(
        [F.lit("WARC-Type: metadata"), _field("WARC-Record-ID", _record_id(page, digest, ":metadata")), _field("WARC-Concurrent-To", own), *common, F.lit("Content-Type: application/warc-fields")],
        F.concat_ws("\r\n", _field("page_id", page.cast("string")), _field("payload_bytes", F.col("payload_bytes").cast("string")), F.lit("")),
    )
    return F.concat(request, F.lit(_END), response, F.lit(_END), metadata)


def write_archives(pages: DataFrame, folder: str, date: str = NO_DATE) -> None:
    """Writes a capture for each row of pages to .txt.gz files (each a gzip member of WARC records) in the folder."""
    text = with_revisits(pages).select(capture_text(date).alias("value"))
    text.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(folder)


# Reading.

RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>, payload binary"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The head (names in lower case) and block of each record of an archive; gzip members are unpacked."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("an archive ends within the head of a record")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin, length = end + 4, int(head.get("content-length", 0))
        if begin + length > len(data):
            raise ValueError(f"an archive ends within the block of {head.get('warc-record-id')}")
        yield head, data[begin : begin + length]
        at = begin + length


def _row(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    fields: dict[str, str] = {}
    payload, intact, length = block, None, len(block)
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(top.decode("utf-8", "replace").split("\r\n")[1:])
        length = len(payload)
        if kind == "revisit":  # the payload is elsewhere; the head that came with it has its length
            length = int(fields.get("content-length", 0))
        elif kind == "response":
            found = hashlib.sha256(payload).hexdigest()
            intact, digest = digest in (None, found), found
    elif head.get("content-type") == "application/warc-fields":
        fields = _fields(block.decode("utf-8", "replace").split("\r\n"))
    return (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), length, digest, intact, list(fields.items()), payload if payloads and kind == "response" else None)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _pieced(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of archives that were parted at each _MARK: a block that holds the mark is put together again."""
    open_piece: list[bytes] = []
    size, whole = 0, 0
    for piece in pieces:
        if not open_piece and not piece.strip():
            continue  # what comes before an archive's first record
        if open_piece:
            open_piece.append(_MARK.encode())
            size += len(_MARK)
        open_piece.append(piece)
        size += len(piece)
        if not whole:
            data = b"".join(open_piece)
            if (end := data.find(b"\r\n\r\n")) < 0:
                continue
            length = re.search(rb"\r\ncontent-length:\s*(\d+)", data[:end], re.I)
            whole = end + 4 + (int(length[1]) if length else 0)
        if size >= whole:
            yield from parse_records(_MARK.encode() + b"".join(open_piece))
            open_piece, size, whole = [], 0, 0
    if open_piece:
        raise ValueError("an archive ends within a record")


def read_records(spark: SparkSession, path: str, payloads: bool = True, plain: bool = False) -> DataFrame:
    """A row for each record of the gzip-compressed archives under the path; with `plain`, of archives that aren't compressed.

    Compressed archives are read as streams. Plain ones, which Spark's text reader would split anywhere, are read whole.
    A response's payload_digest and payload_bytes come from the payload itself, and `intact` says whether the record's
    own digest agrees; a revisit's come from its head. Without `payloads` the payload column is null.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (x.as_py() for batch in batches for x in batch.column(0))
        rows: list[tuple] = []
        size = 0
        for head, block in (r for c in contents for r in parse_records(c)) if plain else _pieced(contents):
            rows.append(_row(head, block, payloads))
            size += len(block) if payloads else 0
            if len(rows) == 512 or size > ARROW_BYTES:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    tuned(spark)
    if plain:
        content = spark.read.format("binaryFile").load(path).select("content")
    else:
        content = spark.read.option("lineSep", _MARK).text(path).select(F.col("value").cast("binary").alias("content"))
    return content.mapInArrow(each, RECORD)


# Assembly.


def _smallest(records: DataFrame, key: str, name: str) -> DataFrame:
    """The record with the smallest id for each key, and how many there are; pre-aggregated, so a hot key is no burden."""
    whole = F.struct("record_id", "uri", "date", "fields")
    return records.groupBy(F.col(key).alias("capture_id")).agg(F.min_by(whole, "record_id").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def assemble(records: DataFrame) -> DataFrame:
    """A nested row for each capture: capture_id, response (n_response), request (n_request), metadata (n_metadata).

    A capture is named by its response's or revisit's record id. Requests name it in WARC-Concurrent-To, or are named by
    it there; metadata name it or its request. Of several records of a kind the one with the smallest id is taken, and
    they are counted; records whose response is missing make captures without one. Records without an id are left out.
    """
    named = records.where("record_id is not null")
    whole = F.struct("record_type", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "intact", "fields", "payload")
    responses = named.where(F.col("record_type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(F.min_by(whole, F.struct("record_type", "uri")).alias("response"), F.min("concurrent_to").alias("request_id"), F.count(F.lit(1)).alias("n_response"))
    requests = _smallest(named.where("record_type = 'request'"), "record_id", "request").withColumnRenamed("capture_id", "request_id")
    own = named.where("record_type = 'request'").groupBy(F.col("record_id").alias("request_id")).agg(F.min("concurrent_to").alias("names"))
    back = responses.where("request_id is not null").groupBy("request_id").agg(F.min("capture_id").alias("named_by"))
    owner = own.join(back, "request_id", "left").select("request_id", F.coalesce("names", "named_by", "request_id").alias("capture_id"))
    asked = requests.join(owner, "request_id").groupBy("capture_id").agg(F.min_by("request", F.col("request.record_id")).alias("request"), F.sum("n_request").alias("n_request"))
    notes = _smallest(named.where("record_type = 'metadata'").withColumn("concurrent_to", F.coalesce("concurrent_to", "record_id")), "concurrent_to", "metadata")
    notes = notes.join(owner.select(F.col("request_id").alias("capture_id"), F.col("capture_id").alias("through")), "capture_id", "left")
    notes = notes.groupBy(F.coalesce("through", "capture_id").alias("capture_id")).agg(F.min_by("metadata", F.col("metadata.record_id")).alias("metadata"), F.sum("n_metadata").alias("n_metadata"))
    return responses.drop("request_id").join(asked, "capture_id", "full_outer").join(notes, "capture_id", "full_outer")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back and returns page_id, payload_bytes, payload_digest, record_type and refers_to.

    The archives go to `folder`, or to a new one in the folder that all executors share,
    where they are deleted once they have been read. A null html is an empty payload, a payload of any length up to what
    one value may hold comes back whole, an empty table gives no rows. Rows that repeat a page come back as often as they
    went; a row without a page_id comes back without one, as a response.
    """
    spark = pages.sparkSession
    into = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, into)
    records = settle(read_records(spark, into, payloads=False))
    if folder is None:
        discard(spark, into)
    captures = assemble(records).where("response is not null")
    page_of = lambda uri: F.regexp_extract(uri, "^<urn:page:(-?[0-9]+):", 1)
    refers = page_of(F.col("response.refers_to"))
    rows = captures.select(
        F.try_element_at("metadata.fields", F.lit("page_id")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(refers != "", refers.try_cast("long")).alias("refers_to"),
        F.explode(F.sequence(F.lit(1), F.col("n_response"))).alias("copy"),
    )
    return rows.drop("copy")


__all__ = ["assemble", "capture_text", "parse_records", "read_records", "round_trip", "with_revisits", "write_archives"]
