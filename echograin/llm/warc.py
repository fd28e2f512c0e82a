"""WARC archives: a writer on Spark's text sink and a sequential, verifying reader.

Each record is one gzip member. The reader takes an archive's members in order, inflates each in small steps, takes
exactly Content-Length bytes as the record's block and checks the block and payload digests.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payloads under this size are always stored whole.
MIN_REVISIT_BYTES = 100
#: Payload bytes after which a task begins a new archive; an archive is read as one binary value, so this and one payload bound a reading task's memory.
ARCHIVE_BYTES = 16 << 20
STEP = 1 << 16
#: Archives that a task may have open before Spark sorts the rest of its records.
WRITERS = 64
#: Bytes of a record that may come before its header ends.
MAX_HEAD = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "archive string, record_no long, record_type string, page_id long, target_uri string, refers_to long, "
    "payload_bytes long, payload_digest string, verified boolean, error string"
)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, _digest, _refers: null for a response, else the smallest page_id with an equal payload. A row without an id refers to it like any other; where none has one, all are responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    ids = pages.select("page_id", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_bytes"))
    firsts = ids.where(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = shared.written(firsts, "warc-firsts")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("_digest"))
    sifted = shared.sieve(rows, shared.written(firsts.select("_digest"), "warc-repeated"), "_digest", "_seen")  # others need not move
    joined = shared.join_groups(sifted.where("_seen").drop("_seen"), firsts, ["_digest"], "_n")
    joined = joined.withColumn("_refers", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")
    return joined.unionByName(sifted.where("NOT _seen").drop("_seen").withColumn("_refers", F.lit(None).cast(pages.schema["page_id"].dataType)))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, which states the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    out = zlib.compressobj(5, zlib.DEFLATED, 31)
    parts = [out.compress("\r\n".join(head).encode() + b"\r\n\r\n"), out.compress(block), out.compress(b"\r\n\r\n"), out.flush()]
    return b"".join(parts)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record per row of pages (page_id long, url string, html string) as archives below path.

    Of rows whose payloads are equal and have at least min_bytes bytes, that with the smallest page_id is a response
    and the others are revisits of it. Spark's text sink writes the archives, so that failed tasks leave nothing
    behind: a gzip member under 16 MB ends in a zero byte, which is given to the sink as its line separator; after a
    larger one the separator is a zero byte of padding, which gzip readers skip. Each task numbers its archives by payload bytes.

    Defined results: null html is an empty payload; a null url leaves out the target; a null page_id gives a record
    without a number, which is a revisit where another row with its payload has an id, else a response; rows that repeat
    the smallest page_id of a payload are all responses; other columns are ignored; an empty table gives no records.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0  # payload bytes so far
        for batch in batches:
            found, files = [], []
            for i in range(batch.num_rows):
                row = [batch.column(k)[i].as_py() for k in range(5)]
                member = record_bytes(*row, date)
                found.append(member[:-1] if member[-1] == 0 else member)
                files.append(held // archive_bytes)
                held += len(row[2])
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(files, pa.int64())], names=["member", "file"])

    rows = mark_revisits(pages, min_bytes).select("page_id", "url", "payload", "_digest", "_refers").mapInArrow(members, "member binary, file long")
    out = rows.select(F.col("member").cast("string").alias("value"), "file")
    conf, name = pages.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(WRITERS))  # else a task sorts its records by their archive, in whose order they come already
    try:
        out.write.option("lineSep", "\x00").partitionBy("file").text(path)
    finally:
        conf.set(name, before)


class Damaged(ValueError):
    """An archive that cannot be read on."""


def _inflated(data: memoryview, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the member at `at`, each with the place in data that is read up to; the last one ends the member."""
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        if at >= len(data):
            raise Damaged("the archive ends inside a record")
        step = data[at : at + STEP]
        try:
            out = inflate.decompress(step)
        except zlib.error as e:
            raise Damaged(f"not a gzip member: {e}") from None
        at += len(step) - len(inflate.unused_data)
        yield out, at


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def _number(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(found[1]) if found else None


def records(content: bytes | memoryview) -> Iterator[dict]:
    """The records of one archive in order, each with its payload; raises Damaged where framing breaks."""
    data, at = memoryview(content), 0
    while True:
        while at < len(data) and data[at] == 0:  # padding between members
            at += 1
        if at >= len(data):
            return
        buffer = bytearray()
        fields: dict[str, str] | None = None
        need = 0
        for piece, at in _inflated(data, at):
            buffer += piece
            if len(buffer) > (MAX_HEAD if fields is None else need + 4):
                raise Damaged("a record is longer than stated")
            if fields is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
                fields = _fields(bytes(buffer[:end]))
                if not fields[""].startswith("WARC/") or not fields.get("content-length", "").isdigit():
                    raise Damaged("no WARC header")
                del buffer[: end + 4]
                need = int(fields["content-length"])
        if fields is None or len(buffer) != need + 4 or buffer[need:] != b"\r\n\r\n":
            raise Damaged("a block does not have its stated length")
        block = bytes(buffer[:need])
        http, _, payload = block.partition(b"\r\n\r\n")
        length = _fields(http).get("content-length", "")
        kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
        good = fields.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}"
        if kind == "response":
            good = good and stated == f"sha256:{hashlib.sha256(payload).hexdigest()}" and length == str(len(payload))
        yield {
            "record_type": kind, "page_id": _number(fields.get("warc-record-id", "")), "target_uri": fields.get("warc-target-uri"),
            "refers_to": _number(fields.get("warc-refers-to", "")), "payload_bytes": int(length) if length.isdigit() else None,
            "payload_digest": stated.removeprefix("sha256:"), "verified": good, "error": None if good else "a digest differs", "payload": payload if kind == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below path, by a sequential read of each; with payloads, their bytes too.

    payload_bytes and payload_digest are those stated, also for revisits; verified tells whether the block digest
    and, for responses, payload digest and length hold. Where an archive's framing breaks, one row of type
    "damaged" with the reason stands for the rest of it; so does one for a record whose header is longer than MAX_HEAD bytes. A folder without records gives an empty table.
    """
    schema = RECORD_SCHEMA + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"archive": pa.string(), "record_no": pa.int64(), "record_type": pa.string(), "page_id": pa.int64(), "target_uri": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "verified": pa.bool_(), "error": pa.string(), "payload": pa.binary()}
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size, no = [], 0, -1
                try:
                    for no, record in enumerate(records(memoryview(content.as_buffer()))):
                        held.append({"archive": name.as_py(), "record_no": no} | record)
                        size += len(record["payload"] or b"") * payloads + 500
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array([r[n] for r in held], types[n]) for n in names], names=names)
                            held, size = [], 0
                except Damaged as e:
                    held.append(dict.fromkeys(names) | {"archive": name.as_py(), "record_no": no + 1, "record_type": "damaged", "verified": False, "error": str(e)})
                yield pa.record_batch([pa.array([r[n] for r in held], types[n]) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole pages table as archives and reads them back. A null html is an empty payload, a null page_id with a repeated payload of 100 bytes or more a revisit of the smallest id; further edge cases as in write_archives() and read_archives()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared.new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "verified")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, url AS target_uri, true AS verified
FROM f
"""
