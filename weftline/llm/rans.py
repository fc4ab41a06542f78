"""Token-id files coded by a static range asymmetric numeral system.

A file holds the ids of consecutive documents. One frequency table, counted over all of the file's ids and scaled to
2^20, is shared by its blocks. A block holds up to ``block_ids`` ids in ``lanes`` interleaved streams, id ``i`` in
lane ``i % lanes``, each with a 64-bit state that gives and takes 32-bit words; a step codes one id a lane as one
vector operation. Blocks are independent: the checkpoint of each in the footer (place, first id, number of ids, checksum) lets any of
them be decoded alone. The footer also has each document's id and length.

Layout: magic, blocks, then the packed table, the packed document list and the checkpoints, then three
lengths and the magic again. A block is its final states, then its words in the decoder's order.

Edge cases: a null or empty text is the end id alone; null ids come last in the order; rows that repeat an id follow each other in the
order of their texts; an empty table gives no file; a document is never split over files, so a file's memory is
bounded by ``file_ids`` and one document; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import store, tokens

MAGIC, SCALE, LOW = b"WFTRANS1", 20, np.uint64(1 << 31)
CHECKPOINT = struct.Struct("<QQII")
INDEX = "part int, seq int, file string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^20, each id that occurs at 1 at least."""
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    scaled = np.maximum(1, counts[present] * (1 << SCALE) // len(ids))
    rest = (1 << SCALE) - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    at = 0
    while rest:
        k = order[at % len(order)]
        step = max(rest, 1 - int(scaled[k])) if rest < 0 else rest
        if rest < 0:
            step = max(step, -(int(scaled[k]) // 2))
        scaled[k] += step
        rest -= step
        at += 1
    out = np.zeros(len(counts), np.uint32)
    out[present] = scaled
    return out


class Table:
    """The shared table in the forms that coding needs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    def lookup(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int) -> bytes:
    n = len(ids)
    x = np.full(lanes, LOW, np.uint64)
    words = []
    shift, up = np.uint64(63 - SCALE), np.uint64(SCALE)
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        part = ids[at : at + lanes]
        f = table.freq[part]
        s = x[: len(part)]
        full = s >= (f << shift)
        if full.any():
            words.append(s[full].astype(np.uint32))
            s = np.where(full, s >> np.uint64(32), s)
        q = s // f
        x[: len(part)] = (q << up) + (s - q * f) + table.start[part]
    return x.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: Table, lookup: np.ndarray, lanes: int) -> np.ndarray:
    x = np.frombuffer(data, "<u8", lanes).copy()
    words = np.frombuffer(data, "<u4", offset=8 * lanes)
    out, at = np.empty(n, np.uint32), 0
    mask, down = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for first in range(0, n, lanes):
        s = x[: min(lanes, n - first)]
        slot = s & mask
        ids = lookup[slot]
        out[first : first + lanes] = ids
        s = table.freq[ids] * (s >> down) + slot - table.start[ids]
        low = np.flatnonzero(s < LOW)
        if len(low):
            s[low] = (s[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        x[: len(s)] = s
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block doesn't end where it should")
    return out


def dump(stream, docs: list[tuple[int | None, int]], ids: np.ndarray, block_ids: int, lanes: int) -> None:
    freq = frequencies(ids)
    table, marks, place = Table(freq), [], len(MAGIC)
    stream.write(MAGIC)
    for first in range(0, len(ids), block_ids):
        part = ids[first : first + block_ids]
        data = encode_block(part, table, lanes)
        stream.write(data)
        marks.append(CHECKPOINT.pack(place, first, len(part), zlib.crc32(data)))
        place += len(data)
    pack = zstandard.ZstdCompressor().compress
    known = np.array([d is not None for d, _ in docs], np.uint8)
    listed = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([n for _, n in docs], "<i8").tobytes() + known.tobytes()
    sections = [pack(freq.astype("<u4").tobytes()), pack(struct.pack("<Q", len(docs)) + listed), struct.pack("<I", lanes) + b"".join(marks)]
    stream.write(b"".join(sections) + struct.pack("<QQQ", *map(len, sections)) + MAGIC)


class Reader:
    """An open file: its documents, and the ids of any block."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = 24 + len(MAGIC)
        stream.seek(size - tail)
        *lengths, magic = struct.unpack(f"<QQQ{len(MAGIC)}s", stream.read(tail))
        if magic != MAGIC:
            raise ValueError("not a token file")
        stream.seek(size - tail - sum(lengths))
        raw = [stream.read(n) for n in lengths]
        unpack = zstandard.ZstdDecompressor().decompress
        self.table = Table(np.frombuffer(unpack(raw[0]), "<u4"))
        self.lookup = self.table.lookup()
        listed = unpack(raw[1])
        n = struct.unpack_from("<Q", listed)[0]
        self.doc_ids, self.lengths = np.frombuffer(listed, "<i8", n, 8), np.frombuffer(listed, "<i8", n, 8 + 8 * n)
        self.known = np.frombuffer(listed, np.uint8, n, 8 + 16 * n).astype(bool)
        self.lanes = struct.unpack_from("<I", raw[2])[0]
        self.marks = list(CHECKPOINT.iter_unpack(raw[2][4:]))
        self.end = size - tail - sum(lengths)

    def block(self, k: int) -> np.ndarray:
        place, _, n, check = self.marks[k]
        self.stream.seek(place)
        data = self.stream.read((self.marks[k + 1][0] if k + 1 < len(self.marks) else self.end) - place)
        if zlib.crc32(data) != check:
            raise ValueError("a block's checksum is wrong")
        return decode_block(data, n, self.table, self.lookup, self.lanes)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc: str = "doc_id", text: str = "text", file_ids: int = 1 << 23, block_ids: int = 1 << 20, lanes: int = 4096) -> DataFrame:
    """Writes ``docs`` in ascending id order into files in ``folder``; returns the index of those that count.

    The texts are range-partitioned and sorted once. Every attempt of a task names its files anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store.filesystem(folder)
        files.create_dir(root, recursive=True)
        coder, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], coder.kind)
        held: list[np.ndarray] = []
        listed: list[tuple[int | None, int]] = []
        size, seq = 0, 0

        def flush():
            nonlocal held, listed, size, seq
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            ids = np.concatenate(held)
            held = []
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                dump(out, listed, ids, block_ids, lanes)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, name, len(listed), size), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "file", "docs", "ids"])
            listed, size, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                ids = coder.encode(t.as_py())
                held += (ids, end)
                listed.append((d.as_py(), len(ids) + 1))
                size += len(ids) + 1
                if size >= file_ids:
                    yield flush()
        if listed:
            yield flush()

    by_id = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, "text")
    return store.write_once(rows.mapInArrow(run, INDEX), "ids-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every document's place, length and checksum, as the files have them, decoded block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store.filesystem(folder)
        for batch in batches:
            for unit in batch.to_pylist():
                with files.open_input_file(f"{root}/{unit['file']}") as stream:
                    yield _rows(Reader(stream), unit["start"])

    def _rows(reader: Reader, start: int) -> pa.RecordBatch:
        ends = np.cumsum(reader.lengths)
        checks = np.zeros(len(ends), np.int64)
        doc, crc = 0, 0
        for k, (_, first, n, _) in enumerate(reader.marks):
            raw = reader.block(k).astype("<u4").tobytes()
            at = first
            while at < first + n:
                stop = min(int(ends[doc]), first + n)
                crc = zlib.crc32(raw[4 * (at - first) : 4 * (stop - first)], crc)
                at = stop
                if at == ends[doc]:
                    checks[doc], crc = crc, 0
                    doc += 1
        return pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64(), mask=~reader.known), pa.array(start + ends - reader.lengths), pa.array(reader.lengths), pa.array(checks)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = index.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("start"))
    return placed.repartition(max(1, min(100_000, index.count()))).mapInArrow(run, ROWS)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = store.folder(docs.sparkSession, "ids")
    return read(write(docs, folder, tokenizer or tokens.default_path()), folder)
