"""WARC in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records, and ends in a seek table: a skippable
frame (format of the seekable Zstandard specification) with the sizes of all frames. An index maps record ids to the
bundle, the frame and the place inside the frame, so that one record costs one frame to read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import strings
from gavilla.operators.keys import attach
from gavilla.session import materialise, scratch_root

BUNDLE_BYTES = 32 << 20  # payload that goes into one bundle, about
READ_BYTES = 16 << 20  # record bytes that one task reads back, about
FRAME_BYTES = 256 << 10  # records are added to a frame until it has this many bytes
# Magic numbers of the seekable format, profile of revisit records, start of record ids.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"

INDEX = "record_id string, page_id bigint, bundle string, frame int, place bigint, bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit of the record of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_ID}{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError if a response does not have the payload that its digest names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or "none" in x else int(x[len(RECORD_ID) + 1 : -1])
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": named, "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the (compressed, plain) size of each frame."""
    body = b"".join(struct.pack("<II", *pair) for pair in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer of an open bundle."""
    end = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    body, at, frames = file.read_at(count * width, end - 9 - count * width), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", body, k * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


def write_bundles(pages: DataFrame, folder: str, parts: int, level: int = 3) -> DataFrame:
    """The index of ``pages`` (page_id, url, html), written as ``parts`` bundles dealt by page_id.

    A bundle is written under a name of its attempt and then moved, so a task that runs twice leaves the same bundle.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        path, draft = f"{root}/bundle-{part:06d}.warc.zst", f"{root}/.draft-{part:06d}-{uuid.uuid4().hex}"
        packer, sizes, out, held, index = zstandard.ZstdCompressor(level=level), [], None, bytearray(), []

        def flush():
            packed = packer.compress(bytes(held))
            out.write(packed)
            sizes.append((len(packed), len(held)))
            held.clear()

        def rows():
            columns = list(zip(*index)) or [()] * 6
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()])],
                names=["record_id", "page_id", "bundle", "frame", "place", "bytes"],
            )

        marked, marks = None, {}  # the page whose marks came last, and what its payloads refer to
        for batch in batches:
            ids, urls, _, shas, refers = (batch.column(i) for i in range(5))
            columns = ids.to_pylist(), urls.to_pylist(), strings(batch.column(2)), shas.to_pylist(), refers.to_pylist()
            for page_id, url, html, sha, refer in zip(*columns):
                if sha is not None:
                    if page_id != marked:
                        marked, marks = page_id, {}
                    marks[sha] = refer
                    continue
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(draft)
                payload = (html or "").encode("utf-8", "surrogatepass")
                named = page_id is not None and page_id == marked
                data = record(page_id, url, payload, marks.get(f"{hashlib.sha1(payload).hexdigest()}:{len(payload)}") if named else None)
                name = "none" if page_id is None else page_id
                index.append((f"<{RECORD_ID}{name}>", page_id, f"bundle-{part:06d}.warc.zst", len(sizes), len(held), len(data)))
                held += data
                if len(held) >= FRAME_BYTES:
                    flush()
            yield rows()
        if out is not None:
            if held:
                flush()
            out.write(seek_table(sizes))
            out.close()
            files.move(draft, path)

    dealt = with_refers(pages).repartition(parts, F.coalesce(F.col("page_id"), F.xxhash64("url", "html")))
    dealt = dealt.sortWithinPartitions("page_id", F.col("sha").asc_nulls_last(), "url")
    return materialise(dealt.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name, each frame read and unpacked once per task that needs it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        opened, name, frame, plain = None, None, None, b""
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            found, held = [], 0
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if opened:
                        opened.close()
                    name, frame = row["bundle"], None
                    opened = files.open_input_file(f"{root}/{name}")
                    frames = read_seek_table(opened)
                if row["frame"] != frame:
                    frame = row["frame"]
                    at, packed, size = frames[frame]
                    plain = zstandard.ZstdDecompressor().decompress(opened.read_at(packed, at), max_output_size=size)
                found.append(parse(plain[row["place"] : row["place"] + row["bytes"]]))
                held += row["bytes"]
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    # The index is tiny beside the payloads, so the number of tasks follows what they will read.
    parts = 1 + int(index.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES
    dealt = index.select("bundle", "frame", "place", "bytes").repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "place")
    return dealt.mapInArrow(read, RECORDS)


def with_refers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha, refers_to): the pages, with sha null, and beside them marks without a payload.

    A mark tells that the payload ``sha`` of a page is that of the smaller page ``refers_to``, the smallest that has it.
    Marks travel to the writer with the pages, so payloads move only once; digests alone are grouped and joined. A page
    without an id refers to none and is referred to by none.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.concat_ws(":", F.sha1(F.col("html").cast("binary")), F.octet_length("html"))
    marks = materialise(rows.where("page_id IS NOT NULL").select("page_id", sha.alias("sha")).distinct(), "payloads")
    groups = marks.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups, "payload-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    again = attach(marks, groups, ["sha"], total, "n").where("page_id > first")
    none = F.lit(None)
    again = again.select("page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "sha", F.col("first").alias("refers_to"))
    plain = rows.select("page_id", "url", "html", none.cast("string").alias("sha"), none.cast("bigint").alias("refers_to"))
    return plain.unionByName(again)


def archive(pages: DataFrame, folder: str | None = None, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, str]:
    """Write ``pages`` (page_id, url, html) as bundles under ``folder``; their index and the folder.

    The folder must be one that every executor can reach (by default one below spark.checkpoint.dir). The number of
    bundles follows the bytes of all payloads.
    """
    folder = folder or f"{scratch_root(pages.sparkSession)}/gavilla/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.replace("file:", "", 1)
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    return write_bundles(pages, folder, 1 + int(total) // bundle_bytes), folder


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from the archives.

    A null html is an empty payload. Rows that repeat a page are records of their own, and all those of the smallest
    page_id are responses. An empty table writes no bundle and gives an empty one.
    """
    index, folder = archive(pages)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
