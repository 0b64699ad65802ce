"""WARC records in seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each holding a group of whole records, and a footer with
the seek table of the public seekable format (a skippable frame that lists the compressed and plain size of
every frame).  A reader needs the footer and one frame to reach a record.  Standard tools see plain
multi-frame ``.zst`` data.

Bundles are written and read by Spark's own text and binary-file sources, so they can lie in any store that
Spark reaches, and a task that is run again cannot leave half a file: the text writer is given one row per
file, and its line separator is the magic number with which every footer ends.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage, shared_folder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = b"\xb1\xea\x92\x8f"
FOOTER_TAIL = 9

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def block_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """Header values stand on one line."""
    return " ".join((value or "").split())


def record_bytes(record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    body = b"" if refers_to is not None else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer for frames of (compressed, plain) sizes."""
    rows = b"".join(struct.pack("<II", *s) for s in sizes)
    tail = struct.pack("<IB", len(sizes), 0) + FOOTER_MAGIC
    return struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(tail)) + rows + tail


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame."""
    frames, flags = struct.unpack("<IB", bundle[-FOOTER_TAIL:-4])
    if bundle[-4:] != FOOTER_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    begin, out, at = len(bundle) - FOOTER_TAIL - width * frames, [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", bundle, begin + width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    """One frame, without touching the others."""
    import zstandard

    at, packed, plain = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, offset of the next record) of the record at an offset in a plain frame."""
    stop = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:stop].decode().split("\r\n")[1:])
    body = data[stop + 4 : stop + 4 + int(headers["Content-Length"])]
    return headers, body, stop + 8 + len(body)


class _Bundle:
    """Collects records into frames, and frames into one file."""

    def __init__(self) -> None:
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=3)
        self.name = uuid.uuid4().hex
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.plain = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.plain, len(record)))
        self.waiting.append(record)
        self.plain += len(record)
        if self.plain >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.waiting:
            self.frames.append(self.packer.compress(b"".join(self.waiting)))
            self.sizes.append((len(self.frames[-1]), self.plain))
            self.waiting, self.plain = [], 0

    @property
    def packed_bytes(self) -> int:
        return sum(p for p, _ in self.sizes)

    def close(self) -> bytes:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle, packed = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            bundle = bundle or _Bundle()
            bundle.add(row["id"], record_bytes(row["id"], row["url"], row["digest"], row["payload"] or b"", row["refers_to"]))
            if len(bundle.sizes) > packed:
                packed = len(bundle.sizes)
                if bundle.packed_bytes >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pydict({"content": [bundle.close()[: -len(FOOTER_MAGIC)]]})
                    bundle, packed = None, 0
    if bundle:
        yield pa.RecordBatch.from_pydict({"content": [bundle.close()[: -len(FOOTER_MAGIC)]]})


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads the largest id is the response.

    Only digests are grouped; a payload that is common makes one row per map task there.  Payloads that
    nobody will store are dropped before the shuffle that brings the roles to the rows.
    """
    digest = F.sha1("payload")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    marks = rows.select("page_id", digest.alias("sha"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least_bytes)
    shared = marks.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("least_id")).where("first_id != least_id").drop("least_id")
    revisits = marks.join(shared, "sha").where("page_id != first_id").select("page_id", "sha", "first_id").distinct()
    # page ids spread the rows evenly, however common a payload is
    out = rows.withColumn("sha", digest).join(revisits, ["page_id", "sha"], "left")
    return out.select(
        "page_id",
        "url",
        F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"),
        "sha",
        F.col("first_id").alias("refers_to"),
    )


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write one record per row of ``page_id, url, html`` as bundles below ``folder``."""
    roles = with_roles(pages, least_bytes)
    records = roles.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"),
        "url",
        _base32(F.col("sha")).alias("digest"),
        "payload",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    files = records.mapInArrow(_pack, "content binary").select(F.col("content").cast("string").alias("value"))
    # one row per file; the line separator supplies the last four bytes
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", FOOTER_MAGIC.decode("latin-1")).text(folder)


def _base32(sha: F.Column) -> F.Column:
    """Upper-case base32 of a hexadecimal SHA-1: every five hexadecimal digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        number = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(number, 15 - 5 * j).bitwiseAND(31) + 1, 1) for j in range(4)]
    return F.concat(*out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("type", pa.string()),
         ("digest", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )
    name = lambda urn: urn.removeprefix("<urn:record:").removesuffix(">")
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            bundle = content.as_py()
            for frame in range(len(read_seek_table(bundle))):
                data, at, rows = read_frame(bundle, frame), 0, []
                while at < len(data):
                    headers, body, end = parse_record(data, at)
                    refers = headers.get("WARC-Refers-To")
                    rows.append(
                        {"id": name(headers["WARC-Record-ID"]), "bundle": path, "frame": frame, "at": at, "size": end - at, "type": headers["WARC-Type"],
                         "digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "url": headers["WARC-Target-URI"],
                         "refers_to": None if refers is None else name(refers), "payload": body}
                    )
                    at = end
                yield pa.RecordBatch.from_pylist(rows, schema)


SCANNED = "id string, bundle string, frame int, at long, size long, type string, digest string, url string, refers_to string, payload binary"


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles with its place: ``bundle`` file, ``frame`` and offset ``at`` inside the plain frame."""
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(_scan, SCANNED)


def record_index(spark: SparkSession, folder: str) -> DataFrame:
    """``id, bundle, frame, at, size``: where each record begins."""
    return read_bundles(spark, folder).select("id", "bundle", "frame", "at", "size")


def read_records(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """The records at the given ``bundle, frame, at`` places; of each bundle only the named frames are unpacked."""

    def fetch(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for frame in sorted({p["frame"] for p in row["places"]}):
                    data = read_frame(row["content"], frame)
                    for p in (p for p in row["places"] if p["frame"] == frame):
                        headers, body, _ = parse_record(data, p["at"])
                        rows.append({"id": headers["WARC-Record-ID"].removeprefix("<urn:record:").removesuffix(">"), "type": headers["WARC-Type"], "payload": body})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("type", pa.string()), ("payload", pa.binary())]))

    # a bundle has a bounded number of records, so its list of places is bounded too
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "at")).alias("places"))
    files = spark.read.format("binaryFile").load(folder)
    return files.join(wanted, files["path"] == wanted["bundle"]).select("content", "places").mapInArrow(fetch, "id string, type string, payload binary")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as bundles into the shared folder, read them back, and describe every record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and the place of the record.  The size
    of a revisit's payload is that of the response it names.  A NULL html is an empty payload, NULL urls are
    empty; repeated page ids with equal payloads are all responses, as neither can name the other; an empty
    table gives no bundle and an empty result.  Columns besides ``page_id, url, html`` play no part.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_bundles(pages, folder, least_bytes)
    found = read_bundles(spark, folder)
    rows = cut_lineage(
        found.select(
            F.col("id").cast("long").alias("page_id"),
            F.octet_length("payload").cast("long").alias("body_bytes"),
            F.sha1("payload").alias("sha"),
            F.col("type").alias("record_type"),
            F.col("refers_to").cast("long").alias("refers_to"),
            "bundle",
            "frame",
            "at",
        )
    )
    # the digest is that of the payload that was read back; a revisit has those of the response that it names
    responses = rows.where("record_type = 'response'").withColumn("payload_digest", _base32(F.col("sha"))).withColumn("payload_bytes", F.col("body_bytes"))
    named = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    revisits = rows.where("record_type = 'revisit'").join(named, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "at"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
