"""Web archives: writing WARC 1.1 records, reading them, and assembling transactions.

Writing is all DataFrame work: each page becomes a request, a response (or a revisit, when an
equal payload has its response elsewhere) and a metadata record; the last two name each other
and the request through ``WARC-Concurrent-To``. Spark's own writer stores them, so archives can
lie in any store that Spark reaches, and a lost task's files are written anew.

Reading parses whole files record by record. :func:`assemble` joins request, response and
metadata records through their concurrent-to identifiers and gives one nested row per capture.

Defined results: a null page or html is an empty payload; a null id or URL leaves its field out
and reads back as null; a URL with blanks or control characters is written percent-encoded as
target and exactly in the metadata record; equal pages with equal ids are separate records, one of
which is the response. A file that ends inside a record gives that record with ``truncated`` set;
so does a record without a sound length, which has an empty block, and reading goes on at the
next version line. Records that no response belongs to form a capture of their own with a null
response. Records with one id and equal content (an archive read twice) count once; different
records of one id are captures of their own, each with the requests and metadata of that id; a
truncated record counts only where no whole one has its id;
records without an id are never equal and are named by file and place. Empty tables give empty
results. Archives are read whole, one file a task, so a file must stay below Spark's 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed_splits, forget, forget_table, saved, scratch, written

#: Fixed values of the formats.
VERSION, BREAK, BASE32 = "WARC/1.1", "\r\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "file string, ordinal long, record_id string, record_type string, date string, target_uri string, "
    "concurrent_to array<string>, refers_to string, named_digest string, status int, payload_bytes long, "
    "payload_digest string, block string, payload binary, truncated boolean, mark binary"
)


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of a hexadecimal string whose length is a multiple of five."""
    parts = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _uuid(*what: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("-")) for x in what)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column | str, rid: Column, date: str, fields: dict[str, Column], block: Column) -> Column:
    """The text of one record; fields that are null are left out."""
    head = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}")]
    head += [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    return F.concat(F.concat_ws(BREAK, *head), F.lit(f"{BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK * 2), block)


def _line(c: Column) -> Column:
    """A header value: breaks would end it."""
    return F.regexp_replace(c.cast("string"), r"[\x00-\x20]", "%20")


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html", per_file: int = 4000, level: str = "BEST_SPEED") -> None:
    """Write pages to path as gzip WARC files; payloads from min_bytes on are stored once.

    level: of zlib, as its names in Hadoop.
    Only the digests that recur are joined to the pages, as a hash table; pages aren't sorted.
    """
    fixed_splits(pages.sparkSession)
    p = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("mid"),
    ).withColumn("n", F.octet_length("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    first = p.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "mid")).alias("best"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("digest", F.col("best.mid").alias("best_mid"))
    p = p.join(first.hint("shuffle_hash"), "digest", "left")
    revisit = F.coalesce(F.col("best_mid") != F.col("mid"), F.lit(False))
    original = F.when(F.col("n") >= min_bytes, _uuid("response", F.col("digest"), F.col("n"))).otherwise(_uuid("response", F.col("page_id"), F.col("mid"), "small"))
    own = F.when(revisit, _uuid("revisit", F.col("page_id"), F.col("mid"))).otherwise(original)
    p = p.withColumn("revisit", revisit).withColumn("original", original).withColumn("rid", own).withColumn("digest32", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest"))))
    req = _uuid("request", F.col("page_id"), F.col("mid"))
    uri = _line(F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("n").cast("string"), F.lit(BREAK * 2))
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{BREAK * 2}"))
    exact = F.when(uri != F.col("url"), F.concat(F.lit("url_base64: "), F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", ""), F.lit(BREAK)))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(BREAK), F.coalesce(exact, F.lit("")))
    records = (
        _record("request", req, date, {"WARC-Target-URI": uri, "WARC-Concurrent-To": F.col("rid"), "Content-Type": F.lit("application/http;msgtype=request")}, asked),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("rid"), date,
            {
                "WARC-Target-URI": uri, "WARC-Payload-Digest": F.col("digest32"), "WARC-Refers-To": F.when(F.col("revisit"), F.col("original")),
                "WARC-Profile": F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), "Content-Type": F.lit("application/http;msgtype=response"),
            },
            F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body"))),
        ),
        _record("metadata", _uuid("metadata", F.col("page_id"), F.col("mid")), date, {"WARC-Target-URI": uri, "WARC-Concurrent-To": F.col("rid"), "Content-Type": F.lit("application/warc-fields")}, fields),
    )
    p.select(F.concat_ws(BREAK * 2, *records).alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", per_file).text(path)


class _Bytes:
    """Bytes of a plain or (multi-member) gzip file, asked for piece by piece."""

    def __init__(self, content: bytes):
        self.raw, self.gz = memoryview(content), content[:2] == b"\x1f\x8b"
        self.at, self.buf, self.z = 0, bytearray(), None
        self.done = False

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 20)]
        self.at += len(piece)
        if not self.gz:
            self.buf += piece
            return True
        data = bytes(piece)
        while data:
            self.z = self.z or zlib.decompressobj(31)
            try:
                self.buf += self.z.decompress(data)
            except zlib.error:
                self.at = len(self.raw)
                return False
            data = self.z.unused_data
            if self.z.eof:
                self.z = None
        return True

    def line(self) -> bytes | None:
        at = 0
        while (cut := self.buf.find(b"\n", at)) < 0:
            at = len(self.buf)
            if not self._more():
                return None
        out = bytes(self.buf[: cut + 1])
        del self.buf[: cut + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _length(fields: dict[str, list[str]]) -> int | None:
    """The one length that a record states; None if there is none or it is no number."""
    told = set(fields.get("content-length", []))
    one = told.pop() if len(told) == 1 else ""
    return int(one) if one.isascii() and one.isdigit() and len(one) < 19 else None


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes, bool]]:
    """(fields by lower-case name, block, truncated) of each record."""
    src = _Bytes(content)
    while (line := src.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        last = None
        while (line := src.line()) not in (None, b"\r\n", b"\n"):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:
                fields[last][-1] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields.setdefault(last, []).append(value.strip())
        size = _length(fields)
        block = src.take(size or 0)
        yield fields, block, line is None or size is None or len(block) < size


def _row(file: str, ordinal: int, fields: dict, block: bytes, truncated: bool, keep: bool) -> tuple:
    one = lambda k: (fields.get(k) or [None])[0]
    kind, status, payload = one("warc-type"), None, block
    if (one("content-type") or "").startswith("application/http") or (kind in ("response", "request", "revisit") and block.startswith((b"HTTP/", b"GET "))):
        head, sep, payload = block.partition(b"\r\n\r\n")
        part = head.split(b" ", 2)
        status = int(part[1]) if len(part) > 1 and head.startswith(b"HTTP/") and part[1].isdigit() else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind in ("response", "resource") else None
    named = one("warc-payload-digest")
    small = block.decode("utf-8", "replace") if kind in ("metadata", "warcinfo", "request") else None
    return file, ordinal, one("warc-record-id"), kind, one("warc-date"), one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), named.partition(":")[2] if named else None, status, len(payload), digest, small, payload if keep else None, truncated, hashlib.sha1(repr(sorted(fields.items())).encode("utf-8", "replace") + block).digest()


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives in path. Payloads are measured, and kept on demand."""

    def run(batches):
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column(0)[i].as_py(), [], 0
                for k, (fields, block, truncated) in enumerate(parse(batch.column(1)[i].as_py())):
                    rows.append(_row(file, k, fields, block, truncated, payloads))
                    held += len(block) if payloads else 1000
                    if held > 1 << 23:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def _distinct_records(records: DataFrame) -> DataFrame:
    """records with id: their own, or file and place. Only those whose id recurs are compared."""
    place = F.concat_ws("#", "file", F.col("ordinal").cast("string"))
    records = records.withColumn("id", F.coalesce("record_id", place))
    again = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    several = records.join(again, "id", "left_semi").select(records.columns)
    whole = several.where(~F.col("truncated")).dropDuplicates(["id", "mark"])
    cut = several.where("truncated").dropDuplicates(["id", "mark"]).join(whole.select("id"), "id", "left_anti").select(records.columns)
    return records.join(again, "id", "left_anti").select(records.columns).union(whole).union(cut)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response and the requests and metadata concurrent to it.

    A concurrent-to field may stand on either side, and metadata may name the request instead of
    the response; both lead to the response. records should be stored: it is read several times.
    """
    records = saved(_distinct_records(records.where(F.col("record_type").isin("request", "response", "revisit", "resource", "metadata"))))
    main = F.col("record_type").isin("response", "revisit", "resource")
    heads, rest = records.where(main), records.where(~main)
    claims = heads.select("id", F.col("id").alias("head_id")).union(heads.select(F.explode("concurrent_to"), "id")).groupBy("id").agg(F.min("head_id").alias("head_id"))
    ties = rest.select(F.col("id").alias("own"), F.explode(F.array_union(F.array("id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("id"))
    known = ties.join(claims, "id").groupBy("own").agg(F.min("head_id").alias("head_id"))
    far = ties.where("id != own").join(known, "own", "left_anti").join(known.withColumnRenamed("own", "id"), "id").groupBy("own").agg(F.min("head_id").alias("head_id"))
    placed = rest.join(known.union(far).withColumnRenamed("own", "id"), "id", "left").withColumn("capture_id", F.coalesce("head_id", "id"))
    part = F.struct("record_id", "date", "target_uri", "status", "block", "truncated")
    group = placed.groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", part))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "metadata", part))).alias("metadata"),
    )
    response = heads.select(
        F.col("id").alias("capture_id"),
        F.struct("record_id", "record_type", "date", "target_uri", "refers_to", "named_digest", "status", "payload_bytes", "payload_digest", "payload", "truncated").alias("response"),
    )
    return response.join(group, "capture_id", "full")


def pages_through_archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to an archive in the shared folder, read it back, and give one row per page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_pages(pages, path, min_bytes)
    block = F.col("metadata")[0]["block"]
    field = lambda name, value: F.nullif(F.regexp_extract(block, rf"(?m)^{name}: ({value})\r?$", 1), F.lit(""))
    records = written(read_records(spark, path), "records")
    captures = assemble(records).select(
        "capture_id", F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("refers_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.named_digest").alias("named_digest"), field("page_id", r"-?\d+").cast("long").alias("page_id"),
        F.coalesce(F.unbase64(field("url_base64", "[A-Za-z0-9+/=]+")).cast("string"), F.col("response.target_uri")).alias("url"),
    )
    captures = saved(captures)
    forget(spark, path)
    forget_table(records)
    target = captures.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    again = F.col("record_type") == "revisit"
    return captures.join(target, "refers_id", "left").select(
        "page_id", F.when(again, F.col("first_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("first_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(again, F.col("first_page")).alias("refers_to"), (F.col("named_digest") == F.coalesce("first_digest", "payload_digest")).alias("digest_holds"), "url",
    )
