"""Substring dedup by compaction of a sampled De Bruijn graph over words.

The edges of the graph are ``K``-word sequences. A window of ``window`` words lies on a path of ``window - K + 1``
edges; the edge of least hash is its anchor, and consecutive windows of one anchor value are a run: a stretch of the path.
Equal windows have equal anchors, so only runs whose anchor occurs again can hold a repeated window.

1. Each text gives its runs: anchor, content hash, place and number of windows.
2. Runs are counted by anchor with partial sums, and those of repeated anchors joined back.
3. Equal runs of one anchor are compacted to one class with its multiplicity. A class of two or more is a repeated path:
   every window in it is repeated, and its occurrences are spans by their coordinates alone. Where an anchor also has
   single runs the path branches; only there are windows compared one by one, each class giving its windows once, from
   the source text at its coordinates.
4. The spans of each text are joined to it, and the words that they cover are removed.

A window's key is its own and its anchor's 64-bit hash, a text's key 96 bits; texts equal in full share one key, as
what is removed from a text depends on nothing but its words, and where an anchor branches one of equal texts gives the windows of all. No group is gathered in one place: counts are partial sums, and joins
have one unique side, so a skewed key of the other can be split.

Edge cases: a null text has no words, as an empty one; one of fewer words than the window keeps all; rows that repeat an
id are documents of their own; a very long text is hashed in chunks of words, in memory a few times its size; equal rows remove each other's words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import store

K, WINDOW = 8, 35
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
RUNS = "anchor long, body long, t long, s int, first int, n int, w int"
_R, _C, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, np.uint64(0xBF58476D1CE4E5B9)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16) * 5 // 4, base % (1 << 64), np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], from one running sum, then mixed."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _pow(base, len(values)), out=total[1:])
    h = (total[ends] - total[starts]) * _pow(pow(base, -1, 1 << 64), len(values) + 1)[starts]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word, in order; bytes are taken in chunks that end at a blank."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + chunk)
        if stop < len(data):
            tail = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, stop - at, at)])
            if len(tail):
                stop = at + int(tail[-1]) + 1
            else:
                later = [x for x in (data.find(c, stop) for c in b" \t\n\x0b\x0c\r") if x >= 0]
                stop = min(later) + 1 if later else len(data)
        buf = np.frombuffer(data, np.uint8, stop - at, at)
        word = np.zeros(len(buf) + 2, np.int8)
        word[1:-1] = ~_BLANK[buf]
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            out.append(ranges(_BYTE[buf], _R, starts, ends) + (ends - starts).astype(np.uint64))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    starts = np.arange(n)
    return ranges(words, _C, starts, starts + size) if n else np.empty(0, np.uint64)


def sliding_min(a: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    rest = size - width
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def runs_of(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, windows, 1, or 2 where some edge occurs twice in the text) of every run."""
    edges = window_hashes(words, K)
    least = sliding_min(edges, window - K + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    n = np.diff(np.concatenate((first, [len(least)])))
    body = ranges(words, _C, first, first + n + (window - 1))
    ranked = np.sort(edges)
    again = bool((ranked[1:] == ranked[:-1]).any())
    return least[first], body, first, n, np.full(len(first), 1 + again)


def runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in RUNS.split(", ")]
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in names]
            held = 0

            def out():
                arrays = [pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds)]
                for c in cols:
                    c.clear()
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for t, s, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                words = word_hashes(text.as_buffer().to_pybytes())
                if len(words) < window:
                    continue
                anchor, body, first, n, w = runs_of(words, window)
                for c, v in zip(cols, (anchor.view(np.int64), body.view(np.int64), np.full(len(n), t), np.full(len(n), s), first, n, w)):
                    c.append(v)
                held += len(n)
                if held > 200_000:
                    held = 0
                    yield out()
            if held:
                yield out()

    return keyed.select("t", "s", F.col("text").cast("binary")).mapInArrow(run, RUNS)


def packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its texts compressed, for the shuffles that bring a text to what is known of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array((pack(x.as_buffer()) for x in batch.column(3)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["doc_id", "t", "s", "z"])

    return keyed.select("doc_id", "t", "s", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, t long, s int, z binary")


def windows_at(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, h, start, mult, t, s): the windows of the stretches listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["anchor", "h", "start", "mult", "t", "s"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = word_hashes(unpack(batch.column(2)[i].as_buffer()))
                spans = batch.column(3)[i].values
                anchor, first, n, mult = (spans.field(k).to_numpy() for k in range(4))
                order = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) + first[order]
                h = ranges(words, _C, start, start + window).view(np.int64)
                m = len(start)
                held.append((anchor[order], h, start, mult[order], np.full(m, batch.column(0)[i].as_py()), np.full(m, batch.column(1)[i].as_py())))
                size += m
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names=names)

    return texts.select("t", "s", "z", "spans").mapInArrow(run, "anchor long, h long, start int, mult long, t long, s int")


def repeated_spans(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(t, s, spans): for each text key, the starts of repeated windows as (first, n) stretches. A written table."""
    table = store.write_once(runs(keyed, window), "runs")
    again = table.groupBy("anchor").agg(F.sum("w").alias("total")).where("total > 1").select("anchor")
    found = store.write_once(table.join(again, "anchor", "left_semi").select("anchor", "body", "t", "s", "first", "n"), "repeated-runs")
    store.drop(table)
    classes = found.groupBy("anchor", "n", "body").agg(F.count("*").alias("mult"), F.min(F.struct("t", "s", "first")).alias("at"))
    classes = store.write_once(classes, "run-classes")
    whole = store.write_once(found.join(classes.where("mult > 1").select("anchor", "n", "body"), ["anchor", "n", "body"], "left_semi").select("t", "s", "first", "n"), "repeated-paths")
    store.drop(found)
    branching = classes.groupBy("anchor").agg(F.min("mult").alias("least")).where("least = 1").select("anchor")
    asked = classes.join(branching, "anchor", "left_semi").select("at.t", "at.s", F.struct("anchor", "at.first", "n", "mult").alias("span"))
    asked = asked.groupBy("t", "s").agg(F.collect_list("span").alias("spans"))  # at most a text's runs
    once = packed(keyed).join(asked, ["t", "s"]).dropDuplicates(["t", "s"])  # one of equal texts speaks for all
    each = store.write_once(windows_at(once, window), "branch-windows")
    store.drop(classes)
    twice = each.groupBy("anchor", "h").agg(F.sum("mult").alias("total")).where("total > 1").select("anchor", "h")
    partly = each.where("mult = 1").join(twice, ["anchor", "h"], "left_semi").select("t", "s", F.col("start").alias("first"), F.lit(1).alias("n"))
    spans = store.write_once(whole.unionByName(partly).groupBy("t", "s").agg(F.collect_set(F.struct("first", "n")).alias("spans")), "repeated-spans")
    store.drop(whole, each)
    return spans


def keyed_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"t": F.xxhash64("text"), "s": F.hash("text")})


def _covered(n: int, spans, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        first, count = spans.field(0).to_numpy(), spans.field(1).to_numpy()
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + (window - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for d, z, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = unpack(z.as_buffer()).split()
                kept, n = words, len(words)
                if spans.is_valid:
                    gone = _covered(n, spans.values, window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((d.as_py(), n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = keyed_texts(docs)
    joined = packed(keyed).join(repeated_spans(keyed, window), ["t", "s"], "left")
    return joined.select("doc_id", "z", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def keep(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that repeated windows cover, and without documents whose words are all covered.

    A kept word keeps the white space before it. ``n_chars``, where there is one, is counted anew; other columns, of
    any names, pass through.
    """
    prefix = "_weft"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    t, s, found = (f"{prefix}_{x}" for x in ("t", "s", "spans"))
    plain = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(*[docs[c] for c in docs.columns], F.xxhash64(plain).alias(t), F.hash(plain).alias(s))
    spans = repeated_spans(keyed_texts(docs), window).select(F.col("t").alias(t), F.col("s").alias(s), F.col("spans").alias(found))
    at, width = docs.columns.index("text"), len(docs.columns)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = list(batch.columns[:width]), batch.schema.names[:width]
            texts, stay = [], []
            for text, spans in zip(columns[at], batch.column(width)):
                left = text.as_py()
                if spans.is_valid:
                    parts = WORD.findall(left)
                    gone = _covered(len(parts), spans.values, window).tolist()
                    left = "".join(p for p, g in zip(parts, gone) if not g)
                    left = left.lstrip(SPACE) if gone[0] else left
                texts.append(left)
                stay.append(not spans.is_valid or bool(left))
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if x is None else len(x) for x in texts]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    joined = keyed.join(spans, [t, s], "left").select(*[keyed[c] for c in docs.columns], found)
    return joined.mapInArrow(run, docs.schema)
