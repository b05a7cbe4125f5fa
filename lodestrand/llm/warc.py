"""WARC archives with revisit resolution.

Only headers (identifier, payload digest, length) are shuffled by digest to find, for each digest, the
record that stays the response. What the payloads meet is the table of the records that are not: by
broadcast if that is small, else by record, so that no payload goes to the task of its digest. The
archives are written by Spark's text writer, whose line separator is the end of a WARC record, so
they go to any file system Spark can write (a file is one gzip member, as that writer makes it), and
are read as binary files by a parser that follows Content-Length and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import store

#: The digits of base 32 as ``conv`` writes them and as RFC 4648 does.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
RECORDS_PER_FILE = 2000
#: Payloads of more bytes go to files of their own, as many to a file as fit into FILE_BYTES.
LARGE_BYTES, FILE_BYTES = 1 << 17, 1 << 28
#: Up to so many rows a table of short rows is broadcast; beyond, it is repeated for each salt.
BROADCAST_ROWS, SALTS = 200_000, 16


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base 32 SHA-1: five hexadecimal digits make four of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, RFC32)


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with a table of one row a key (null equals null); rows of a hot key stay spread."""
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS))
    table = table.withColumnsRenamed({k: f"its_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in keys]
    if small:
        joined = rows.join(F.broadcast(table), match, how)
    elif "record_id" in keys:
        joined = rows.join(table, match, how)
    else:
        table = table.withColumn("its_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = rows.join(table, [*match, salt == F.col("its_salt")], how).drop("its_salt")
    return joined.drop(*(f"its_{k}" for k in keys))


def _is_small(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record_id, payload_digest, first_id) of the records that revisit another, from headers only.

    Of the records of a digest the one with the smallest identifier is the first; digests of one record don't matter.
    """
    same = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts, path = store.settle(same.where("n > 1 and first_id is not null").drop("n"), "warc-firsts")
    met = _meet(heads, firsts, ["payload_digest"], _is_small(firsts)).where("not (record_id <=> first_id)")
    found, _ = store.settle(met.select("record_id", "payload_digest", "first_id").distinct(), "warc-revisits")
    store.remove(heads.sparkSession, path)
    return found


def _base(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    if not isinstance(pages.select(F.col(id_col)).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: record identifiers are whole numbers")
    payload = F.coalesce(F.col(body_col), F.lit(""))
    return pages.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))


def records(base: DataFrame, revisits: DataFrame, date: str) -> DataFrame:
    """(record_id, payload_bytes, record_type, warc): the text of each record without the final CRLF CRLF."""
    base = _meet(base, revisits, ["record_id", "payload_digest"], _is_small(revisits), "left")
    revisit = F.col("first_id").isNotNull()
    # an identifier in the archive is the number of the record; null is written as nil
    urn = lambda c: F.concat(F.lit("<urn:lodestrand:"), F.coalesce(c.cast("string"), F.lit("nil")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("record_id"))), F.lit(f"WARC-Date: {date}"),
        F.when(F.length(clean) > 0, F.concat(F.lit("WARC-Target-URI: "), clean)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return base.select("record_id", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.concat(head, F.lit(CRLF * 2), block).alias("warc"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row into gzip-compressed archives under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the smallest identifier
    becomes a response, the others revisits of it without payload; shorter payloads are all
    responses. Null html is the empty payload, a null url gives no target URI, control characters
    and spaces in a url become %20. Rows that repeat the smallest identifier are all responses; a
    null identifier is larger than any, and alone in its group a response. Identifiers are whole
    numbers; others raise TypeError. An empty table writes no records. Further columns are not read.
    A file holds ``records_per_file`` records at most, or a few of more than ``LARGE_BYTES``, and so
    about ``FILE_BYTES`` or one record.
    """
    spark, base = pages.sparkSession, _base(pages, id_col, url_col, body_col)
    heads, heads_path = store.settle(base.select("record_id", "payload_digest", "payload_bytes"), "warc-heads")
    most = heads.agg(F.max("payload_bytes")).first()[0] or 0
    made = records(base, resolve(heads, min_bytes), date)
    for rows, per_file in ((made.where(F.col("payload_bytes") <= LARGE_BYTES), records_per_file), (made.where(F.col("payload_bytes") > LARGE_BYTES), min(records_per_file, max(1, FILE_BYTES // max(1, most))))):
        if per_file == records_per_file or most > LARGE_BYTES:
            rows.select("warc").write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    store.remove(spark, heads_path)


class RecordReader:
    """Splits a stream of chunks into (headers, block) by Content-Length; holds one record at a time."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer = chunks, bytearray()

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.buffer += chunk
        return True

    def _take(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self._fill(1):
            at = self.buffer.find(b"\r\n\r\n")
            while at < 0:
                seen = len(self.buffer)
                if not self._fill(seen + 1):
                    raise ValueError("the archive ends inside a header")
                at = self.buffer.find(b"\r\n\r\n", max(0, seen - 3))
            lines = self._take(at + 4)[:-4].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            block = self._take(int(head["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end with two line ends")
            yield head, block


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of one or more gzip members in pieces."""
    unit, at = zlib.decompressobj(31), 0
    while at < len(data):
        piece = unit.decompress(data[at : at + step])
        if piece:
            yield piece
        at += step
        while unit.eof and (rest := unit.unused_data):
            unit = zlib.decompressobj(31)
            if piece := unit.decompress(rest):
                yield piece


READ_SCHEMA = "record_id bigint, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, url string, payload string"


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:lodestrand:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _parse(batches):
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)], names)
    for batch in batches:
        for data in batch.column(0):
            rows, held = [], 0
            for head, block in RecordReader(inflate(data.as_buffer())):
                kind, body = head["warc-type"], block.partition(b"\r\n\r\n")[2]
                whole = kind == "response"
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if whole and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
                rows.append((_number(head["warc-record-id"]), kind, digest, _number(head.get("warc-refers-to")), len(body) if whole else None, head.get("warc-target-uri"), body.decode("utf-8") if whole else None))
                held += len(body)
                if held > 4 << 20 or len(rows) >= 2000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``, revisits without payload: see READ_SCHEMA. A response whose payload doesn't have the digest in its header raises ValueError."""
    store.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, READ_SCHEMA)


def resolved_headers(archived: DataFrame) -> DataFrame:
    """The headers of all records; a revisit takes its length from the response with its digest."""
    heads = archived.select("record_id", "record_type", "payload_digest", "refers_to", "payload_bytes")
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes")
    asked = revisits.select("payload_digest", F.col("refers_to").alias("record_id")).distinct()
    full = heads.where("record_type = 'response'").join(asked, ["record_id", "payload_digest"]).groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    full, _ = store.settle(full, "warc-originals")
    return heads.where("record_type = 'response'").unionByName(_meet(revisits, full, ["payload_digest"], _is_small(full)))


def dedup_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages``, read them back, and return the resolved headers. The archives go when they are read."""
    spark = pages.sparkSession
    path = store.table_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, body_col, min_bytes)
    heads, _ = store.settle(read_archives(spark, path).drop("payload", "url"), "warc-headers")
    store.remove(spark, path)
    return resolved_headers(heads)
