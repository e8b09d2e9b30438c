"""WARC archives: writing, reading, and revisit resolution.

Archives are written by Spark's own text writer with the end of a record (two line ends) as the separator of rows: header and
block are joined from bytes by built-in functions, so payloads may be any bytes, the commit protocol covers lost
executors, and any file system that Spark knows will do. They are read by the text reader with the same separator. What it
returns are pieces of records, in order, as payloads may hold the separator; a small parser in each task
puts them together by Content-Length, one record at a time. A gzip file is never split, so its pieces meet in one task.

Resolution moves headers only. Records are reduced by payload digest to the first response of each digest, joined back to all others
of that digest, responses and earlier revisits alike, and new archives are written with fresh headers: the first as a response, the others
as revisits that name its id, address and date. Digests of which very many records exist are joined by broadcast if they
are few, so the merge of the rest has no hot key. Only then payloads move, once, to meet their decisions by file and place.

Defined results: a null payload is empty; a null key or uri leaves its field out and reads as null; keys order as integers, null last, then
by file and place, so of repeated rows one is the response; payloads below LEAST bytes are always responses; control characters and
spaces in an address are percent-encoded; an empty table gives archives without records. A record that ends early is read as far as it goes, with
complete false. Records of other types than response and revisit are copied as they are. A revisit without an
original in the archives stays one, with the reference that it had. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, remove, shared_dir, ship, stored

ship(__name__)

LEAST = 100
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that the parser passes on at a time.
BATCH = 4 << 20


# -- writing --------------------------------------------------------------------------------------


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _address(uri: Column) -> Column:
    """uri with control characters and spaces percent-encoded, so that it stays within its line."""
    encoded = uri
    for code in (*range(0x21), 0x7F):
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(uri.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(uri)


def _record_id(*parts: Column) -> Column:
    """A name-based UUID of what tells a record from others."""
    h = F.md5(F.concat_ws("\t", *parts))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("3"), at(14, 3)), F.concat(F.lit("8"), at(18, 3)), at(21, 12)), F.lit(">"))


def http_header(size: Column) -> Column:
    """The HTTP header of a page of that many bytes, without its last line end."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string")).cast("binary")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = F.concat(F.lit("WARC/1.1\r\n"), *[_line(k, v) for k, v in fields], _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return F.concat(head.cast("binary"), block)


def records(rows: DataFrame) -> DataFrame:
    """record: the bytes of each row's record, without the two line ends behind it.

    rows: type (response or revisit), record_id, key, uri, date, content (the block's content type), digest (lower-case hex SHA-256 of the payload), http
    (binary, null if the block has no HTTP header), payload (binary), and of the original refers_to, refers_uri and refers_date, null for a response.
    """
    sha = lambda c: F.concat(F.lit("sha256:"), c)
    block = F.concat(F.coalesce(F.concat("http", F.lit(END)), F.lit(b"")), F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b""))))
    rows = rows.withColumn("__bf_block", block)
    fields = [
        ("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri")),
        ("X-Page-ID", F.col("key").cast("string")), ("WARC-Payload-Digest", sha(F.col("digest"))), ("WARC-Block-Digest", sha(F.sha2("__bf_block", 256))),
        ("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(PROFILE))), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        ("WARC-Refers-To-Date", F.col("refers_date")), ("Content-Type", F.col("content")),
    ]
    return rows.select(_record(fields, F.col("__bf_block")).alias("record"))


def write(found: DataFrame, path: str) -> None:
    """Writes the column record (binary) to gzip archives in the folder path, one file a task."""
    text = found.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def captures(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """record: a response record for each row of pages (key, uri, payload)."""
    size = F.octet_length("payload")
    rows = pages.select(F.col("key").cast("long").alias("key"), _address(F.col("uri")).alias("uri"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumns({"type": F.lit("response"), "date": _date(date), "content": F.lit("application/http;msgtype=response"), "http": http_header(size)})
    rows = rows.withColumn("record_id", _record_id(F.lit("capture"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("uri", F.lit("")), F.col("digest")))
    return records(rows.withColumns({c: F.lit(None).cast("string") for c in ("refers_to", "refers_uri", "refers_date")}))


def _date(at: Column | None) -> Column:
    """A timestamp (default: now) as a field of a header."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- reading --------------------------------------------------------------------------------------

_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)")
#: Blocks that are parted into HTTP header and payload.
_HTTP = re.compile(rb"(?is)(?=.*^WARC-Type:[ \t]*(?:response|revisit)\b)(?=.*^Content-Type:[ \t]*application/http)", re.M)
_PIECES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("head", pa.binary()), ("http", pa.binary()), ("payload", pa.binary()), ("complete", pa.bool_())])


class _Records:
    """Puts records together from the pieces of files, which come one after another, in order.

    A payload that ends with part of a separator shifts where the pieces are cut, so lengths decide, not pieces: between two
    pieces stands a separator whose first bytes may belong to a block.
    """

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.held = 0
        self.file, self.at, self.head = None, 0, None

    def piece(self, file: str, piece: bytes) -> None:
        if file != self.file:
            self.end()
            self.file, self.at = file, 0
        elif self.head is not None and self.parts and self.have < self.want <= self.have + len(END):
            self.parts.append(b"")
            piece = self._ended() + piece
        if self.head is None:
            piece = piece.lstrip(b"\r\n")
            if piece[:5] == b"WARC/":  # else it belongs to no record
                self.head, self.parts, self.have = piece, [], 0
                length = _LENGTH.search(piece)
                self.want = int(length[1]) if length else 0
            return
        self.have += len(piece) + len(END) * bool(self.parts)
        self.parts.append(piece)
        if self.have >= self.want:
            rest = self._ended()
            if rest:  # no separator stood behind the block
                self.piece(file, rest)

    def _ended(self) -> bytes:
        """Takes the record that is open; what is left behind its block."""
        data = END.join(self.parts)
        block, rest, http = data[: self.want], data[self.want :], None
        if _HTTP.match(self.head):
            http, _, block = block.partition(END)
        self.out.append((self.file, self.at, self.head, http, block, len(data) >= self.want))
        self.held, self.head, self.at = self.held + len(block), None, self.at + 1
        return rest

    def end(self) -> None:
        """The file has ended: a record that is open has what it has."""
        if self.head is not None:
            self._ended()

    def taken(self) -> pa.RecordBatch:
        rows, self.out, self.held = self.out, [], 0
        return pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, x, strict=True)) for x in rows], _PIECES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Records()
    for b in batches:
        for file, piece in zip(b.column("file").to_pylist(), b.column("value"), strict=True):
            found.piece(file, piece.as_py())
            if found.held >= BATCH:
                yield found.taken()
    found.end()
    if found.out:
        yield found.taken()


def field(name: str) -> Column:
    """The first value of a header field, null where it is absent."""
    found = F.regexp_extract(F.concat(F.decode("head", "UTF-8"), F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the gzip archives under path.

    file, at (its number in the file), head (the header's bytes), http (the HTTP header, null without one), payload, complete; type, record_id, uri,
    date, key, content, declared (the header's payload digest, bare), refers_to, refers_uri, refers_date.
    """
    text = spark.read.option("lineSep", END.decode()).text(path)
    pieces = text.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))
    found = pieces.mapInArrow(_parsed, "file string, at long, head binary, http binary, payload binary, complete boolean")
    names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "content": "Content-Type", "refers_to": "WARC-Refers-To", "refers_uri": "WARC-Refers-To-Target-URI", "refers_date": "WARC-Refers-To-Date"}
    fields = {k: field(v) for k, v in names.items()} | {"key": field("X-Page-ID").cast("long"), "declared": F.regexp_replace(field("WARC-Payload-Digest"), "^[A-Za-z0-9-]+:", "")}
    return found.withColumns(fields)


# -- resolution -----------------------------------------------------------------------------------


def headers(found: DataFrame, *more: str) -> DataFrame:
    """What resolution needs of records: file, at, type, record_id, uri, date, key, digest and size of the payload; a revisit has its declared digest and a null size."""
    response = F.col("type") == "response"
    return found.where("type in ('response', 'revisit')").select(
        "file", "at", "type", "record_id", "uri", "date", "key",
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("declared")).alias("digest"), F.when(response, F.octet_length("payload").cast("long")).alias("size"), *more,
    )


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """file, at, origin_id (its fresh id), origin_uri, origin_date of all records of heads (a stored table) that are to be revisits of another."""
    large = heads.where(F.col("size").isNull() | (F.col("size") >= least))
    origin = F.min(F.when(F.col("type") == "response", F.struct(F.col("key").isNull().alias("none"), "key", "file", "at", "record_id", "uri", "date")))
    first = large.groupBy("digest").agg(origin.alias("origin"), F.count("*").alias("n")).where("origin is not null and n > 1")
    first = stored(first.select("digest", "n", *[F.col(f"origin.{c}").alias(f"origin_{c}") for c in ("file", "at", "record_id", "uri", "date")]), "originals")
    pairs = join_split(large.select("digest", "file", "at"), first, ["digest"], "n").where("not (file = origin_file and at = origin_at)")
    return pairs.select("file", "at", _fresh("origin_").alias("origin_id"), "origin_uri", "origin_date")


def _fresh(prefix: str = "") -> Column:
    return _record_id(F.lit("deduplicated"), *[F.coalesce(F.col(prefix + c).cast("string"), F.lit("")) for c in ("record_id", "file", "at")])


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST) -> None:
    """Reads the archives under source and writes them to target with all but the first record of each payload as revisits."""
    found = read(spark, source)
    decided = stored(revisits(stored(headers(found), "headers"), least), "revisits")
    rows = found.join(decided, ["file", "at"], "left")
    ours = F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False))
    built = rows.where(ours).select(
        F.when(F.col("origin_id").isNotNull(), F.lit("revisit")).otherwise(F.col("type")).alias("type"), _fresh().alias("record_id"), "key", "uri", "date", "content", "http", "payload",
        F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("declared")).alias("digest"),
        F.coalesce("origin_id", "refers_to").alias("refers_to"), F.coalesce("origin_uri", "refers_uri").alias("refers_uri"), F.coalesce("origin_date", "refers_date").alias("refers_date"),
    )
    # Others keep their header, with the length of what was read.
    head = F.regexp_replace(F.decode("head", "ISO-8859-1"), r"(?im)^Content-Length:[^\r\n]*", F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string")))
    other = found.where(~F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False))).select(F.concat(F.encode(head, "ISO-8859-1"), F.lit(END), "payload").alias("record"))
    write(records(built).unionByName(other), target)


def resolved(found: DataFrame) -> DataFrame:
    """key, size, digest, type, origin (the key of a revisit's original) of the responses and revisits of archives (from read).

    A revisit that names a response of these archives has its size and digest; another has its declared digest and a null size.
    """
    heads = stored(headers(found, "refers_to"), "headers")
    again = heads.where("type = 'revisit'")
    named = again.groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n"))
    origin = heads.where("type = 'response'").select("record_id", F.col("key").alias("origin"), F.col("size").alias("origin_size"), F.col("digest").alias("origin_digest"))
    origin = stored(named.join(origin, "record_id", "left").withColumnsRenamed({"record_id": "refers_to"}), "originals")
    known = join_split(again.where("refers_to is not null"), origin, ["refers_to"], "n")
    known = known.select("key", F.col("origin_size").alias("size"), F.coalesce("origin_digest", "digest").alias("digest"), "type", "origin")
    lost = again.where("refers_to is null").select("key", "size", "digest", "type", F.lit(None).cast("long").alias("origin"))
    return heads.where("type = 'response'").select("key", "size", "digest", "type", F.lit(None).cast("long").alias("origin")).unionByName(known).unionByName(lost)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages (key, uri, payload) to archives in the shared folder, deduplicates these, and returns what the new ones hold (resolved)."""
    spark = pages.sparkSession
    source, target = (f"{shared_dir(spark)}/boxframe-{uuid.uuid4().hex}/{name}" for name in ("captures", "archives"))
    write(captures(pages), source)
    deduplicate(spark, source, target)
    remove(spark, source.rpartition("/")[0])
    return resolved(read(spark, target))
