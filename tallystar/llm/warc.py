"""WARC archives of Zstandard frames with a dictionary per archive, written and read through Spark's own file access.

Pages of equal payload share a digest; the least page id of a digest is found by aggregation, which combines in the map
tasks, and joined back by digest. A task then turns its rows into archives of at most ``archive_bytes`` before
compression. For each archive a dictionary is built from records spread over that archive (at most ``sample_bytes`` of
them), stored compressed in a skippable frame that opens the archive, and every record becomes a frame of its own under
that dictionary. No sample or dictionary passes through the driver, and a lost task repeats only its own archives.

An archive is one row, written by the text writer with one row a file, so that Spark's commit protocol and file systems
apply. The line separator is an empty skippable frame, which decoders pass over: every file is plain Zstandard.

Payloads of at least ``least`` bytes that occur again become revisit records, which keep length and digest and name the
record with the payload. Reading goes through the ``binaryFile`` source and checks every payload against its digest.

Defined cases: a null payload is empty. Payloads below ``least`` bytes are all responses. Rows that repeat the least page
id of a payload are the same page: each is a response. A null id is larger than any other; if all ids of a payload are
null, all of its rows are responses. A null url writes no target; control characters and blanks in a url become %XX. Ids
of any type are written as text. An archive of too few records for training has no dictionary. A record longer than
``archive_bytes`` is an archive of its own. An empty table gives no archive and no rows. Further columns are not archived.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.llm.shared import positional
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CREATED = "2000-01-01T00:00:00Z"

# --- fixed values of the formats ---

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # a skippable frame (magic 0x184D2A50) without content
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# --- end of fixed values ---

_UNSAFE = re.compile(r"[\x00-\x20\x7F]")
RECORDS = ("page_id string, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to string, intact boolean, payload binary")


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 least: int = LEAST_BYTES) -> DataFrame:
    """One row per page: page_id and refers_to as text, url, payload, payload_digest."""
    frame, names = positional(pages, page_id, url, html)
    payload = F.coalesce(F.col(names[html]).cast("binary"), F.lit(b""))
    rows = frame.select(F.col(names[page_id]).alias("id"), F.col(names[url]).cast("string").alias("url"),
                        payload.alias("payload"))
    noted = rows.withColumns({"payload_digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    copies = noted.where(F.col("n") >= least).groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")).where("copies > 1 AND first IS NOT NULL")
    # Short payloads have no copies to meet; a key of their own spreads them.
    key = F.when(F.col("n") >= least, F.col("payload_digest")).otherwise(
        F.concat(F.lit("/"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    linked = noted.withColumn("key", key).join(copies.withColumnRenamed("payload_digest", "key"), "key", "left")
    repeated = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return linked.select(F.col("id").cast("string").alias("page_id"), "url", "payload", "payload_digest",
                         F.when(repeated, F.col("first").cast("string")).alias("refers_to"))


def _record_id(page_id: str | None, digest: str) -> str:
    named = hashlib.sha256(f"{page_id}/{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=named[:16], version=5)}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to, created: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
             "WARC-Record-ID: " + _record_id(page_id, digest), "WARC-Date: " + created]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url))
    if page_id is not None:
        lines.append("X-Page-Id: " + quote(page_id, safe=""))
    if refers_to is not None:
        lines += ["WARC-Profile: " + REVISIT_PROFILE, "WARC-Refers-To: " + _record_id(refers_to, digest),
                  "X-Refers-To-Page-Id: " + quote(refers_to, safe="")]
    lines += ["WARC-Payload-Digest: sha256:" + digest, "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _spread(records: list[bytes], most: int) -> list[bytes]:
    """Records at even distances, cut short if long, of at most ``most`` bytes together."""
    share = max(1, sum(len(r) for r in records) // most + 1)
    return [r[:most // 8] for r in records[::share]]


def archive(records: list[bytes], sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES,
            level: int = LEVEL) -> bytes:
    """Records as an archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(dictionary_bytes, _spread(records, sample_bytes), k=256, d=8, level=level)
    except zstandard.ZstdError:  # too little to learn from
        trained = None
    parts = []
    if trained is not None:
        stored = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored)
        trained.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    return b"".join(parts + [packer.compress(r) for r in records])


def _archives(created, archive_bytes, sample_bytes, dictionary_bytes, level):
    def packed(records):
        return pa.RecordBatch.from_arrays(
            [pa.array([archive(records, sample_bytes, dictionary_bytes, level)], pa.binary())], ["archive"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for at in range(batch.num_rows):
                record = _record(*(c[at].as_py() for c in columns), created)
                if held and size + len(record) > archive_bytes:
                    yield packed(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield packed(held)
    return run


def write_archives(records: DataFrame, path: str, created: str = CREATED, archive_bytes: int = ARCHIVE_BYTES,
                   sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES,
                   level: int = LEVEL) -> None:
    """Write the rows of :func:`page_records` as archives below ``path``, which must not exist."""
    made = records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(
        _archives(created, archive_bytes, sample_bytes, dictionary_bytes, level), "archive binary")
    made.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option(
        "maxRecordsPerFile", 1).text(path)


def _opened(content: pa.Buffer):
    """The uncompressed records of an archive as a stream."""
    import zstandard

    known = None
    if content.size >= 8:
        magic, length = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            stored = content.slice(8, length).to_pybytes()
            if stored[:4] == zstandard.FRAME_HEADER:
                stored = zstandard.ZstdDecompressor().decompress(stored)
            known = zstandard.ZstdCompressionDict(stored, dict_type=zstandard.DICT_TYPE_FULLDICT)
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    return io.BufferedReader(unpacker.stream_reader(content, read_across_frames=True), 1 << 18)


def _fields(stream) -> dict[str, str]:
    """Header fields up to the empty line, names in lower case."""
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        found[name.lower()] = value
    return found


def records_of(content: pa.Buffer, payloads: bool = True):
    """The response and revisit records of an archive, as tuples of the columns of ``RECORDS``."""
    with _opened(content) as stream:
        while opening := stream.readline():
            if not opening.startswith(b"WARC/"):
                raise ValueError(f"no record where one should start: {opening[:40]!r}")
            head = _fields(stream)
            length = int(head["content-length"])
            block = stream.read(length)
            if len(block) != length or stream.read(4) != b"\r\n\r\n":
                raise ValueError("record cut short")
            kind = head["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            inner = io.BytesIO(block)
            inner.readline()
            size, digest = int(_fields(inner)["content-length"]), head["warc-payload-digest"].partition(":")[2]
            body = block[inner.tell():] if kind == "response" else None
            intact = None if body is None else len(body) == size and hashlib.sha256(body).hexdigest() == digest
            page_id, first = head.get("x-page-id"), head.get("x-refers-to-page-id")
            yield (page_id if page_id is None else unquote(page_id), head.get("warc-target-uri"), kind, size, digest,
                   first if first is None else unquote(first), intact, body if payloads else None)


_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]


def _read(payloads: bool):
    names = [field.split(" ")[0] for field in RECORDS.split(", ")]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), _KINDS)], names)

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for content in batch.column(0):
                for record in records_of(content.as_buffer(), payloads):
                    found.append(record)
                    held += len(record[-1] or b"") + 200
                    if held > 8 << 20:
                        yield rows(found)
                        found, held = [], 0
            if found:
                yield rows(found)
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, columns ``RECORDS``.

    ``intact`` says whether a payload has its length and digest, and is null for revisits, which have no payload.
    ``payloads=False`` leaves the payloads out after checking them.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(payloads), RECORDS)
