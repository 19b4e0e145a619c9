"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``, each compressed on its
own. A bundle ends with the seek table of the published seekable format (a
skippable frame with the compressed and full size of every frame), so that any
frame can be found and decompressed alone, while ordinary tools read the bundle
from front to back. The index maps a record's identifier to its bundle, frame,
and offset and length within the frame.

Payloads of at least ``REVISIT_BYTES`` bytes that occur more than once are
written once, for the largest page_id; the other records are revisits that refer
to it. The payload of a null page is empty. Rows that repeat a page_id have the
same record identifier and are all written; a null page_id is written as "null"
and never stands for another page's payload.

A bundle is written under a name of the task attempt and renamed when it is whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import new_folder, open_folder, stored

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
#: Bytes of records that one task reads.
READ_BYTES = 1 << 24
REVISIT_BYTES = 1000
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# Numbers of the seekable format, and names of the WARC standard.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, bundle string, frame int, offset int, length int"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_id_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit of another one's payload."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    target = "".join((url or "").split()) or f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, its HTTP head's length of the payload, and the payload where it has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        if name == "Content-Length":
            fields["payload_bytes"] = int(value)
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


class BundleWriter:
    """Frames of records, then the seek table. The file gets its name when it is closed."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        self.name = name
        self.fs, self.base = open_folder(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.draft = f"{self.base}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset and length at which the record will stand."""
        if self.held and self.size + len(data) > FRAME_BYTES:
            self._end_frame()
        place = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return place

    def _end_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)))
        self.out.write(entries + footer)
        self.out.close()
        self.fs.move(self.draft, f"{self.base}/{self.name}")


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        fs, base = open_folder(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(size - 9 - 8 * count)
        table = self.file.read(8 * count)
        self.frames, start = [], 0
        for packed, full in struct.iter_unpack("<II", table):
            self.frames.append((start, packed, full))
            start += packed

    def frame(self, number: int) -> bytes:
        start, packed, full = self.frames[number]
        self.file.seek(start)
        return self.decompressor.decompress(self.file.read(packed), max_output_size=full)

    def close(self) -> None:
        self.file.close()


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload another page's record holds."""
    rows = stored(
        _page_rows(pages).select(
            "page_id",
            F.sha1("payload").alias("digest"),
            F.xxhash64("payload").alias("check"),
            F.octet_length("payload").alias("size"),
        ),
        "warc-digests",
    ).where(F.col("size") >= REVISIT_BYTES)
    same = ["digest", "check", "size"]
    groups = rows.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and refers_to is not null").drop("n")
    found = rows.join(groups, same).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; the rows of the index say where each record stands."""
    rows = _page_rows(pages)
    known = revisits(pages).select(F.col("page_id").alias("revisit_id"), "digest", "refers_to")
    same = rows["page_id"].eqNullSafe(known["revisit_id"]) & (F.sha1(rows["payload"]) == known["digest"])
    decided = rows.join(known, same, "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, bundles = TaskContext.get().partitionId(), 0
        bundle = None
        names = ["record_id", "bundle", "frame", "offset", "length"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            found = []
            columns = [column.to_pylist() for column in batch.columns]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if bundle is not None and bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle, bundles = None, bundles + 1
                if bundle is None:
                    bundle = BundleWriter(folder, f"part-{part:06d}-{bundles:04d}.warc.zst")
                place = bundle.add(record(page_id, url, payload, refers_to))
                found.append((record_id(page_id), bundle.name, *place))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )
        if bundle is not None:
            bundle.close()

    return decided.mapInArrow(write, INDEX_SCHEMA)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, frame by frame, with their payloads' size and digest.

    Digests are computed anew where the payload is there and must agree with the
    record's own field.
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        bundle, reader, number, frame = None, None, None, b""
        for batch in batches:
            rows = []
            places = zip(batch["bundle"], batch["frame"], batch["offset"], batch["length"], strict=True)
            for name, frame_number, offset, length in places:
                if name != bundle:
                    if reader is not None:
                        reader.close()
                    bundle, reader, number = name, BundleReader(folder, name), None
                if frame_number != number:
                    number, frame = frame_number, reader.frame(frame_number)
                fields = parse(frame[offset : offset + length])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = fields["payload"]
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{fields['WARC-Record-ID']} in {name} is damaged")
                refers_to = fields.get("WARC-Refers-To")
                rows.append(
                    (
                        page_id_of(fields["WARC-Record-ID"]),
                        fields["payload_bytes"] if payload is None else len(payload),
                        digest,
                        fields["WARC-Type"],
                        None if refers_to is None else page_id_of(refers_to),
                    )
                )
            frame_of = pd.DataFrame(
                rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )
            yield frame_of.astype({"page_id": "Int64", "refers_to": "Int64"})
        if reader is not None:
            reader.close()

    # By the size of the records, not of the index rows.
    size = index.agg(F.coalesce(F.sum(F.col("length").cast("bigint")), F.lit(0))).first()[0]
    return (
        index.repartition(max(1, -(-size // READ_BYTES)), "bundle", "frame")
        .sortWithinPartitions("bundle", "frame", "offset")
        .mapInPandas(
            read,
            "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        )
    )


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write bundles and their index; the index, read back, and the bundles' folder."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_bundles(pages, f"{folder}/bundles").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index"), f"{folder}/bundles"
