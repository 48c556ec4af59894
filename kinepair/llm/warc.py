"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records
up to FRAME_BYTES, and a seek table as a skippable frame at its end: the compressed
and plain size of every frame. A record is found by bundle, frame number and
offset within the frame: reading it takes the table, one range of the file and one frame.

Records with equal payloads of at least REVISIT_BYTES are stored once: the one with the
largest id is a response, the others are revisits of it.

Defined results: a null html is an empty payload, a null url an absent target; a null id is
smaller than any other; repeated rows are written each, and where their id is the
largest all of them are responses; an empty table gives no bundle and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.llm.common import skew_lookup, whole_text
from kinepair.sources.staging import shared_dir, staged

REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3

# Numbers and names of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, start int, length int"
RECORD = "page_id long, record_type string, refers_to long, url string, payload binary, payload_digest string"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    return None if name in (None, "<urn:page:none>") else int(name[len("<urn:page:"):-1])


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_name(page_id), "WARC-Date": DATE,
            "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(), "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if revisit:
        head |= {"WARC-Refers-To": record_name(refers_to), "WARC-Profile": REVISIT_PROFILE}
    else:
        block += payload
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at an offset."""
    data = bytes(data) if isinstance(data, memoryview) else data
    gap = data.index(b"\r\n\r\n", at)
    lines = data[at:gap].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at offset {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = gap + 4, int(head["Content-Length"])
    if data[start + size:start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at offset {at} has a wrong length")
    return head, data[start:start + size], start + size + 4


def _row(head: dict[str, str], block: bytes) -> dict:
    """A parsed record as a RECORD row; the digest of stored bytes is computed and compared."""
    from urllib.parse import unquote

    said, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if head["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if hashlib.sha1(payload).hexdigest() != said:
            raise ValueError(f"{head['WARC-Record-ID']} does not have its digest")
    url = head.get("WARC-Target-URI")
    return {"page_id": _number(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": _number(head.get("WARC-Refers-To")),
            "url": None if url is None else unquote(url), "payload": payload, "payload_digest": said}


class BundleWriter:
    """Writes one bundle; `place` tells where the latest record went."""

    def __init__(self, out):
        self.out, self.table, self.frame, self.size = out, [], bytearray(), 0
        self.add(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 26\r\n\r\nformat: WARC File Format\r\n\r\n\r\n"
                 % (str(uuid.uuid4()).encode(), DATE.encode()))

    def add(self, record: bytes) -> tuple[int, int]:
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.table), len(self.frame)
        self.frame += record
        return place

    def _flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.size, self.frame = self.size + len(packed), bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads frames of a bundle through its seek table."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * frames)
        table, at = source.read(8 * frames), 0
        self.frames = []
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        writer, name, rows = None, "", []

        def finish():
            # A bundle gets its final name when it is whole; only the index of a finished task counts.
            writer.close()
            files.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                                              names=["page_id", "bundle", "frame", "start", "length"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                if writer is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(files.open_output_stream(f"{root}/.{name}", compression=None))
                record = make_record(page_id, url, html or b"", refers_to)
                rows.append((page_id, name, *writer.add(record), len(record)))
                if writer.size > BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return run


#: Frames that a task reads.
TASK_FRAMES = 64


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the id of the response that holds an equal payload, else null."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(whole_text("html").cast("binary"), 256).alias("sha"))
    long = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    groups = staged(long.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    found = skew_lookup(rows, groups, "sha", "n", total)
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages as bundles in a folder that all executors share; returns the written INDEX of records."""
    return staged(with_revisits(pages).mapInArrow(_write(folder), INDEX), "warc-index")


def _read(folder: str):
    """Rows (bundle, frame, starts): the records at these offsets, or all of a frame where `starts` is null."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            for bundle, frame, starts in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != name:
                    name, reader = bundle, BundleReader(files.open_input_file(f"{root}/{bundle}"))
                data, out = reader.frame(frame), []
                if starts is None:
                    at = 0
                    while at < len(data):
                        head, block, at = parse_record(data, at)
                        if head["WARC-Type"] != "warcinfo":
                            out.append(_row(head, block))
                else:
                    out = [_row(*parse_record(data, at)[:2]) for at in starts]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read_archive(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles in the index, frame by frame."""
    return _dealt(index.groupBy("bundle", "frame").agg(F.lit(None).cast("array<int>").alias("starts"))).mapInArrow(_read(folder), RECORD)


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames dealt over tasks of at most TASK_FRAMES or so, all of about one size: the list of frames is tiny next to what they hold, so its size says nothing."""
    listed = staged(frames, "warc-frames")
    tasks = max(1, listed.sparkSession.sparkContext.defaultParallelism, -(-listed.count() // TASK_FRAMES))
    return listed.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")


def read_records(folder: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the wanted page_ids only, each frame that holds some read once."""
    chosen = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return _dealt(chosen.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("start")).alias("starts"))).mapInArrow(_read(folder), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes an archive, reads it back and resolves revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/kinepair/warc-{uuid.uuid4().hex}"
    index = write_archive(pages, folder)
    back = staged(read_archive(spark, folder, index).select("page_id", "record_type", "refers_to", "payload_digest", F.length("payload").cast("long").alias("payload_bytes")), "warc-records")
    # The bytes that a revisit stands for are those of the response with the id and digest it names.
    key = lambda number: F.concat_ws(":", number, "payload_digest").alias("key")
    revisits = back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", key("refers_to"))
    named = revisits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    held = back.where("record_type = 'response'").select(key("page_id"), "payload_bytes", "payload_digest").distinct().join(named, "key")
    held = staged(held, "warc-responses")
    resolved = skew_lookup(revisits, held, "key", "n", held.agg(F.sum("n")).first()[0] or 0)
    checked = F.coalesce("payload_digest", F.raise_error(F.lit("a revisit names a record that is not there")).cast("string"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return back.where("record_type = 'response'").select(*columns).unionByName(resolved.withColumn("payload_digest", checked).select(*columns))
