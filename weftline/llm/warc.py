"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A skippable frame at the end of each archive holds the seek
table (compressed and plain size and checksum of every frame), and the index table maps each record to its archive,
frame and offset in the plain bytes of that frame, so one record is read by decompressing one frame.

Records of equal payload of at least ``min_revisit`` bytes are written once: the one with the largest id is the
``response``, the others are ``revisit`` records without payload that name it.

Edge cases: a null payload counts as empty; a null id is never a keeper while another id exists and is written as
``null``; a payload larger than a frame has one of its own; rows that repeat the largest id are all responses; a null target URI leaves the header out; empty input
gives no archive and an empty index; columns other than the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import store

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, record_type string, archive string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_revisits(pages: DataFrame, record_id: str, uri: str, payload: str, min_revisit: int) -> DataFrame:
    """Every record with its payload, digest and, for one that repeats another's payload, the id of that one.

    Only digests are grouped, with partial aggregation, so a payload that a third of all rows share is one row per
    task; digests seen once never enter the join.
    """
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    shared = (
        rows.where(F.col("bytes") >= min_revisit)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max("record_id").alias("keeper"))
        .where((F.col("n") > 1) & F.col("keeper").isNotNull())
        .select("digest", "bytes", "keeper")
    )
    kept = F.when(~F.col("record_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(shared, ["digest", "bytes"], "left").select("record_id", "uri", "payload", "digest", "bytes", kept.alias("refers_to"))


def record(record_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. The HTTP head keeps the full payload's length, also where the payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if record_id is None else record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive under construction."""

    def __init__(self, files, path: str, level: int):
        self.out, self.packer, self.at, self.table = files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level), 0, []

    def add(self, plain: bytes) -> tuple[int, int, int]:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        start, self.at = self.at, self.at + len(packed)
        self.table.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        return len(self.table) - 1, start, len(packed)

    def close(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(stream) -> list[tuple[int, int, int, int]]:
    """(start, packed size, plain size, checksum) of every frame, from the footer."""
    size = stream.size()
    stream.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE or descriptor != 0x80:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 12 * n)
    rows, at, raw = [], 0, stream.read(12 * n)
    for packed, plain, check in struct.iter_unpack("<III", raw):
        rows.append((at, packed, plain, check))
        at += packed
    return rows


def read_frame(stream, row: tuple[int, int, int, int]) -> bytes:
    start, packed, plain, check = row
    stream.seek(start)
    data = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain) if plain else b""
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum doesn't match the seek table")
    return data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record in a frame's plain bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, data[start:stop]
        at = stop + 4


def write(records: DataFrame, folder: str, frame_bytes: int = 1 << 18, archive_bytes: int = 1 << 30, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives into ``folder`` and returns the index, itself written there.

    Each attempt of a task writes under names of its own and the index holds those of the attempt that succeeded,
    so a repeated task leaves at most an unlisted file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store.filesystem(folder)
        files.create_dir(root, recursive=True)
        archive, name, pending, size, rows = None, "", [], 0, []

        def flush():
            nonlocal pending, size
            frame, start, packed = archive.add(b"".join(x for *_, x in pending))
            at = 0
            for rid, kind, raw in pending:
                rows.append((rid, kind, name, frame, start, packed, at, len(raw)))
                at += len(raw)
            pending, size = [], 0

        def out():
            nonlocal rows
            done, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), TYPES)], names=NAMES)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "uri", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                rid, uri, payload, digest, refers = (c[i].as_py() for c in cols)
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = _Archive(files, f"{root}/{name}", level)
                raw = record(rid, uri, payload, digest, refers, date)
                pending.append((rid, "response" if refers is None else "revisit", raw))
                size += len(raw)
                if size >= frame_bytes:
                    flush()
                    if archive.at >= archive_bytes:
                        archive.close()
                        archive = None
            if len(rows) >= 10_000:
                yield out()
        if pending:
            flush()
        if archive is not None:
            archive.close()
        if rows:
            yield out()

    NAMES = [x.split()[0] for x in INDEX.split(", ")]
    TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]
    return store.write_once(records.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, frames_per_task: int = 16) -> DataFrame:
    """Reads every record of the archives that ``index`` lists, frame by frame through the seek tables.

    Each payload's digest is computed anew and must equal the one in its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store.filesystem(folder)
        for batch in batches:
            for unit in batch.to_pylist():
                rows = []
                with files.open_input_file(f"{root}/{unit['archive']}") as stream:
                    table = seek_table(stream)
                    for row in table[unit["unit"] * frames_per_task : (unit["unit"] + 1) * frames_per_task]:
                        for headers, block in parse(read_frame(stream, row)):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            size = int(head.rpartition(b"Content-Length: ")[2])
                            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError("a payload doesn't match its digest")
                            rows.append((_page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    units = index.select("archive", F.floor(F.col("frame") / frames_per_task).cast("int").alias("unit")).distinct()
    n = max(1, min(100_000, index.agg(F.count_distinct("archive", F.floor(F.col("frame") / frames_per_task))).first()[0]))
    return units.repartition(n).mapInArrow(run, RECORD)


def lookup(row: dict, folder: str) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record by its row of the index: one frame is read and decompressed, no other."""
    files, root = store.filesystem(folder)
    with files.open_input_file(f"{root}/{row['archive']}") as stream:
        plain = read_frame(stream, seek_table(stream)[row["frame"]])
    return next(parse(plain[row["offset"] : row["offset"] + row["length"]]))


def _page(urn: str | None) -> int | None:
    value = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value in (None, "null") else int(value)


def round_trip(pages: DataFrame, record_id: str = "page_id", uri: str = "url", payload: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Writes ``pages`` to archives and returns what reading them gives, one row a record."""
    folder = store.folder(pages.sparkSession, "warc")
    index = write(plan_revisits(pages, record_id, uri, payload, min_revisit), folder)
    return read(index, folder)
