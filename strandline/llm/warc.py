"""WARC archives of pages: a response for each different payload, revisits of it for the other pages, written by Spark and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.storage import fresh_folder, saved

#: An empty gzip member. It follows each record's own member, so Spark's text source can cut an archive at records, and any
#: other reader of gzip gets nothing from it. Two of its bytes can't follow each other in UTF-8, so no stored text holds it.
MARK = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + "\x00" * 8
#: The format's version, and the profile of a revisit whose payload is the same.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")
RECORDS = "record_id string, record_type string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal digest: five of its digits are four of base32."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{run} {row}'.encode(), digest_size=16).digest())}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A whole record: named fields (those without a value left out), an empty line, the block, and the two line ends that close it."""
    own = [*fields, ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in own if v is not None)
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, head.encode(), block)


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(6, wbits=31)
    return made.compress(data) + made.flush()


def _uri(url: str | None) -> str | None:
    """A URL that fits on a header's line: blanks and control characters as %XX."""
    return _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None


def _members(run: str, date: str):
    """Rows of roles, with the payload where it is a response, as gzip members."""

    def one(r: dict) -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
        revisit = r["payload"] is None
        kind = "revisit" if revisit else "response"
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", _record_id(run, r["row"])), ("WARC-Date", date), ("WARC-Target-URI", _uri(r["url"])),
            ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("X-Page-ID", r["page_id"]),
        ]
        if revisit:
            fields += [
                ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(run, r["first_row"])),
                ("WARC-Refers-To-Target-URI", _uri(r["first_url"])), ("WARC-Refers-To-Date", date),
            ]
        return _member(record([*fields, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + r["payload"]))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: strandline\r\nformat: WARC File Format 1.1\r\n")
        first = [_member(info)]
        for batch in batches:
            made, size = first, 0
            for i in range(len(batch)):
                made.append(one({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                size += len(made[-1])
                if size > 16 << 20:
                    yield pa.record_batch([pa.array(made, pa.binary())], ["member"])
                    made, size = [], 0
            yield pa.record_batch([pa.array(made, pa.binary())], ["member"])
            first = []

    return run_


def write_archives(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html"
) -> str:
    """Write a record for each row into archives below ``folder`` (a new one in the shared folder, if none is given), and return it.

    Of the rows whose payloads are equal (by SHA-256 beside the SHA-1 that archives state), and of ``least_bytes`` or more, the one with
    the largest id is a response, the others revisits of it; all shorter ones are responses. Only headers (ids, addresses, digests) are
    shuffled to decide that. Payloads are shuffled once, by digest, one for each digest and task (a partial aggregation), so
    a page that a third of all rows have is sent as often as there are tasks. Files are written by Spark's own
    text sink with its commit protocol, so they can be anywhere that Spark can write, and lost tasks leave nothing behind. Each
    record is a gzip member of its own; each file begins with a warcinfo record; a file may be renamed to ``.warc.gz`` as it is.

    A null payload is empty. A null id is less than any other and is left out of the record; of rows that repeat id and payload
    one is the response. A null URL is left out; blanks and control characters in one are written as %XX. Other columns are not looked at.
    An empty table gives a folder without records.
    """
    spark = pages.sparkSession
    folder = folder or f"{fresh_folder(spark)}/archives"
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.unhex(F.sha2(payload, 256))
    heads = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        key.alias("key"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    heads = saved(heads.withColumn("payload_digest", base32_of_hex("sha1")).drop("sha1"), "headers")
    groups = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("many")).where("many > 1")
    # of several rows with that id, the one that was read first
    tops = heads.join(groups.drop("many"), "key").where(F.col("page_id").eqNullSafe(F.col("first_id"))).groupBy("key").agg(F.min("row").alias("first_row"))
    urls = heads.select(F.col("row").alias("first_row"), F.col("url").alias("first_url"))
    roles = saved(heads.join(saved(tops.join(urls, "first_row"), "firsts"), "key", "left"), "roles")
    alone = F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
    bodies = pages.select(key.alias("key"), payload.alias("payload")).groupBy("key").agg(F.any_value("payload").alias("payload"))
    records = roles.where(alone).join(bodies, "key").unionByName(roles.where(~alone).withColumn("payload", F.lit(None).cast("binary")))
    run, date = uuid.uuid4().hex, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = records.select("row", "page_id", "url", "payload_digest", "payload_bytes", "first_row", "first_url", "payload")
    own.mapInArrow(_members(run, date), "member binary").select(F.col("member").cast("string")).write.option("lineSep", MARK).option("encoding", "ISO-8859-1").text(folder)
    return folder


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record in an uncompressed archive; what isn't whole is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not the beginning of a record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(fields["content-length"])
        block = data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
            raise ValueError(f"{fields.get('warc-record-id')} is cut")
        at += 4
        yield fields, block


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of ``RECORDS``; a digest that doesn't fit is an error. The payload is what follows the block's own header."""
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", None)):
        kind, _, digest = fields.get(name, "").partition(":")
        if content is None and fields["warc-type"] == "response":
            content = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        if content is not None and kind == "sha1" and base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
            raise ValueError(f"{name} of {fields.get('warc-record-id')} differs")
    held = content is not None
    page = fields.get("x-page-id")
    return (
        fields.get("warc-record-id"), fields["warc-type"], int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-date"),
        fields.get("warc-payload-digest", "").rpartition(":")[2] or None, len(content) if held else None, fields.get("warc-refers-to"), content if held and with_payload else None,
    )


def _unpacked(data: bytes) -> bytes:
    """All gzip members of ``data``, unpacked; what isn't packed stays."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(wbits=31)
        out.append(one.decompress(data))
        if not one.eof:
            raise ValueError("a gzip member is cut")
        data = one.unused_data
    return b"".join(out)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, whole_files: bool = False) -> DataFrame:
    """The response and revisit records (columns ``RECORDS``) of the archives in ``folder``.

    Archives of ``write_archives`` are cut at their records, so a file is read by as many tasks as it has splits and a task holds few
    records at a time. Other archives, packed or not, need ``whole_files``: a file is then one row, of 2 GB at most. Lengths and
    digests are checked; a difference is an error. Other kinds of records are passed over; an empty folder gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = [
                    _row(fields, block, with_payload)
                    for data in batch.column(0).slice(lo, 256)
                    for fields, block in parsed(_unpacked(data.as_py()))
                    if fields["warc-type"] in ("response", "revisit")
                ]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    if whole_files:
        source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    else:
        source = spark.read.option("lineSep", MARK).option("encoding", "ISO-8859-1").text(folder).select(F.col("value").cast("binary"))
    return source.mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of the response that a revisit stands for).

    A revisit is joined to the response it names, or, if it names none, to the response of its digest (the largest page_id of several).
    Where that isn't there, payload_bytes and refers_to are null. Both sides of the join should be files, as archives are: then
    adaptive execution splits the revisits of a page that very many share.
    """
    mine = F.struct("page_id", "payload_bytes")
    answers = records.where("record_type = 'response'")
    by_id = answers.select(F.col("record_id").alias("key"), mine.alias("its"))
    by_digest = answers.where("payload_digest is not null").groupBy(F.col("payload_digest").alias("key")).agg(F.max(mine).alias("its"))
    again = records.where("record_type = 'revisit'").withColumn("key", F.coalesce("refers_to", "payload_digest"))
    found = again.join(by_id.unionByName(by_digest), "key", "left")
    return answers.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select(again.page_id, F.col("its.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("its.page_id").alias("refers_to"))
    )


def deduplicated_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``resolved`` rows of the archives that ``write_archives`` makes of ``pages``."""
    folder = write_archives(pages, least_bytes=least_bytes)
    return resolved(saved(read_archives(pages.sparkSession, folder, with_payload=False).drop("payload"), "records"))
