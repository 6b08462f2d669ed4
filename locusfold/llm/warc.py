"""WARC archives whose repeated payloads are revisit records, and their reading and resolution.

Headers alone are grouped by payload digest; a page then learns the first page of its payload by a join on it. Groups
with at least a thousandth of all repeated rows, at most a thousand groups, are sent to all tasks; all others are
too small to make a partition heavy. Records are written and read by Spark's text source with the separators of the
format, so archives lie in any store, survive retried tasks, and are read as streams of one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_batches

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A group is heavy from this share of the rows on; so many heavy groups exist at most.
HEAVY = 1000


def base32_sha1(data: Column) -> Column:
    """SHA-1 of binary data in base 32: four letters for every five hexadecimal digits."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        five = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(five, k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_firsts(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` left-joined with `firsts`, one row per key with the number `n` of its rows, without gathering heavy keys."""
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.broadcast(firsts.filter(F.col("n") * HEAVY >= total).drop("n"))  # at most HEAVY rows
    light = firsts.filter(F.col("n") * HEAVY < total).drop("n")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(keys), keys, "left_anti").join(light, keys, "left"), allowMissingColumns=True)


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """Name-based, so that a revisit can name the record of another task."""
    h = F.md5(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _uri(url: Column) -> Column:
    """Header values hold no line ends: control characters and spaces are percent-encoded."""
    return reduce(lambda s, c: F.replace(s, F.lit(chr(c)), F.lit(f"%{c:02X}")), range(33), url)


def archive_records(pages: DataFrame, least: int = 0, date: str | None = None) -> DataFrame:
    """page_id, record_type and `record` (text without its final separator) of each page.

    Of pages whose payloads (html in UTF-8; null: empty) are equal and have `least` bytes or more, that with the smallest
    page_id is the response, others are revisits of it; rows that repeat its page_id with that payload are its record
    again. A null page_id counts as larger than all others; a group of null ids only has responses. Ties of a page_id
    between different urls: the smaller url is named in revisits. A null url gives no target header. Other columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("n_bytes"), F.sha2(html.cast("binary"), 256).alias("wide"),
    )
    keys = ["digest", "n_bytes", "wide"]  # equal SHA-1 values can be made on purpose, so a second digest stands by
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id").alias("id"), F.col("url").isNull().alias("bare"), "url"))
    firsts = rows.drop("html").filter(F.col("n_bytes") >= least).groupBy(*keys).agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1")
    firsts = materialize(firsts.select(*keys, "n", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("known")))
    found = with_firsts(rows, firsts, keys)
    again = F.col("known").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit(END))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    revisit = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("first_url"), F.col("digest"))),
        line("WARC-Refers-To-Target-URI", _uri(F.col("first_url"))), line("WARC-Refers-To-Date", when),
    )
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", when), line("WARC-Target-URI", _uri(F.col("url"))), line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(again, revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    return found.withColumn("block", block).select("page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), F.concat(header, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str | None = None) -> None:
    """Writes the records of `archive_records` as gzip files of about one shuffle partition each."""
    archive_records(pages, least, date).select("record").write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = (
    "record_id string, record_type string, target_uri string, date string, page_id string, refers_to_record string, declared_digest string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def parse_record(data: bytes, payloads: bool) -> tuple:
    """A row of RECORD from a record after its version line. The payload follows the HTTP header; a revisit has none."""
    head, _, block = data.partition(END.encode())
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    block = block[:int(fields["content-length"])]
    payload = None
    if fields.get("warc-type") != "revisit":
        payload = block.partition(END.encode())[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    get = fields.get
    return (
        get("warc-record-id"), get("warc-type"), get("warc-target-uri"), get("warc-date"), get("x-page-id"), get("warc-refers-to"),
        (get("warc-payload-digest") or "").removeprefix("sha1:") or None, None if payload is None else len(payload), digest, payload if payloads else None,
    )


def _records(rows: Iterator[tuple[str, bytes]], payloads: bool) -> Iterator[tuple]:
    """Pieces of files in order to records: a payload that holds the separator is joined again by its length."""
    start, between = f"{VERSION}\r\n".encode(), f"{END}{VERSION}\r\n".encode()
    file, parts, missing = None, [], 0
    for name, piece in rows:
        if parts and name != file:
            raise ValueError(f"a record of {file} is cut off")
        if not parts:
            piece = piece.removeprefix(start)
            if not piece.strip():
                continue
            head, _, block = piece.partition(END.encode())
            size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length")
            missing = size - len(block)
        else:
            parts.append(between)
            missing -= len(between) + len(piece)
        parts.append(piece)
        file = name
        if missing <= 0:
            yield parse_record(b"".join(parts), payloads)
            parts = []
    if parts:
        raise ValueError(f"a record of {file} is cut off")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of archives (gzip, or other codecs that are not split) as rows of RECORD, bytes and digests taken from what is read.

    `payload` is null unless `payloads`; revisits have neither payload nor bytes nor digest of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(spark)
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((n, p) for b in batches for n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held: list[tuple] = []
        size = 0
        for r in _records(pieces, payloads):
            held.append(r)
            size += len(r[-1] or b"") + 500
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    pieces = spark.read.option("lineSep", f"{END}{VERSION}\r\n").schema("value string").text(path)
    return pieces.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record; revisits take bytes, digest and
    refers_to from the response that they name, nulls where it is not there."""
    records = materialize(records.drop("payload"))
    responses = (
        records.filter("record_type = 'response'").dropDuplicates(["record_id"])
        .select("record_id", F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    )
    revisits = records.filter("record_type = 'revisit'").withColumnRenamed("record_id", "own_id").withColumnRenamed("refers_to_record", "record_id")
    named = materialize(revisits.filter("record_id is not null").groupBy("record_id").agg(F.count("*").alias("n")).join(responses, "record_id"))
    found = with_firsts(revisits, named, ["record_id"]).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type",
        F.col("first_id").cast("long").alias("refers_to"),
    )
    own = records.filter("record_type = 'response'").select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found)


def archive_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives of all pages to the shared folder, reads them back and resolves their revisits."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return resolve(read_archives(pages.sparkSession, path))
