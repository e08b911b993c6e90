"""WARC archives in which repeated payloads are stored once.

``resolve`` shuffles only the headers of the captures, by payload digest: of captures with
equal payloads the one with the largest key is the original, all others revisit it. ``write``
joins that back to the payloads by row number, which no key can skew, and writes WARC 1.1
files: full responses, and revisits with fresh headers and no payload. ``read`` parses
archives by Content-Length and checks every payload against its digest; ``lookup`` joins
revisits to their originals.

Null payloads are empty ones. A null key is smaller than all others and has no header. Rows
that share key and payload are captures of their own: one is the original. Only the three
named columns are read, whatever others there are. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import kept

#: Records of a file at most, so that a reader can hold one file.
FILE_RECORDS = 20_000

# Fixed values of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: 5 bytes at a time are one number and 8 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("capture-"), number.cast("string"))),
                                                          "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _captures(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("no"), F.col(key).cast("long").alias("key"), F.col(url).alias("url"),
                     F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))


def resolve(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(no, original: struct of key, no, url) of each capture that revisits another.

    Payloads of fewer than ``min_bytes`` bytes are never revisits.
    """
    heads = kept(captures.select("no", "key", "url", F.octet_length("payload").alias("bytes"), sha1_base32(F.col("payload")).alias("digest"))
                 .filter(F.col("bytes") >= min_bytes), "warc-headers")
    groups = heads.groupBy("digest").agg(F.max(F.struct("key", "no", "url")).alias("original"), F.count("*").alias("n"))
    groups = kept(groups.filter("n > 1").drop("n"), "warc-originals")
    return heads.join(groups, "digest").filter("no != original.no").select("no", "original")


def _record(date: str) -> Column:
    """The text of one record, without the blank lines that end it."""
    def line(name: str, value: Column) -> Column:  # left out where the value is null
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))

    def uri(column: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.col(column), "\r", "%0D"), "\n", "%0A")

    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size, F.lit(_END * 2))
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("no"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))),
        line("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("original.no")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, uri("original.url"))),
        line("X-Key", F.col("key").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END), block)


def write(df: DataFrame, folder: str, key: str, url: str, payload: str, min_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``df`` to new gzip files in ``folder``.

    Rows are told apart by their place. ``df`` is read once and kept with their numbers: another job
    may split it in another way and number its rows anew.
    """
    captures = kept(_captures(df, key, url, payload), "warc-captures")
    links = resolve(captures, min_bytes)
    records = captures.join(links, "no", "left").select(_record(date).alias("record"))
    # the writer ends each row with the separator, and so each record with two blank lines
    (records.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split(_END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        end = head + 4 + int(headers["content-length"])
        if data[end: end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't as long as it says")
        yield headers, data[head + 4: end]
        at = end + 4


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(record_id, record_type, key, url, digest, bytes, refers_to[, payload]) of all records.

    ``bytes``: of the payload; null for revisits, which have none. Fails where a payload doesn't
    match its digest.
    """
    schema = "record_id string, record_type string, key long, url string, digest string, bytes long, refers_to string" + ", payload binary" * payloads
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(gzip.decompress(content.as_py() or gzip.compress(b""))):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    body = None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4:]
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"record {head['warc-record-id']} doesn't match its digest")
                    rows.append((head["warc-record-id"], kind, int(head["x-key"]) if "x-key" in head else None, head.get("warc-target-uri"),
                                 digest, None if body is None else len(body), head.get("warc-refers-to"), body)[: len(names)])
                if rows:
                    types = [pa.int64() if n in ("key", "bytes") else pa.binary() if n == "payload" else pa.string() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def lookup(records: DataFrame) -> DataFrame:
    """(key, url, bytes, digest, record_type, refers_to_key): each record, revisits with what
    their originals hold. Fails where a revisit's original is missing or has another digest."""
    originals = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("refers_to_key"), F.col("bytes").alias("original_bytes"),
        F.col("digest").alias("original_digest"))
    revisits = records.filter("record_type = 'revisit'").join(originals, "refers_to", "left").filter(
        F.when(F.col("digest") == F.col("original_digest"), F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("no original of the same digest for "), "record_id")).cast("boolean")))
    return (records.filter("record_type = 'response'").select("key", "url", "bytes", "digest", "record_type", F.lit(None).cast("long").alias("refers_to_key"))
            .unionByName(revisits.select("key", "url", F.col("original_bytes").alias("bytes"), "digest", "record_type", "refers_to_key")))
