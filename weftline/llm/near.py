"""Near-duplicate classes by ProbMinHash.

A text is its set of five-word shingles, each weighted ``1 + ln(count)``. Every shingle's arrivals are a Poisson process at the rate of
its weight; each arrival falls on one of ``m`` components, and a component's signature is the shingle that arrives
first. A shingle stops as soon as its next arrival is later than every component's first. Two signatures agree in
a component with the probability Jaccard similarity of the weights.

A signature keeps 16 bits of each of its 80 components, and a band is four of them side by side in one long, so the 20 bands are
the signature. Texts that agree in a band share a bucket. A bucket's members are first compared with its leader, the member that shares
most bucket places, which is where a group of copies has its centre. Links join texts to classes; buckets of more than one class are
gone through again, every two members of different classes: their signatures are held against each other in blocks of members, and pairs that agree in
less than ``similarity - slack`` of the components are let go (at the defaults a pair of 0.8 is with probability 4e-6). Every other
pair is verified on whole texts: plain or probability Jaccard of at least ``similarity``. So of two texts that share a bucket, either links
join them already, or they were compared; classes are the connected components of all links.

Equal texts are one node from the start, so a text that a third of all rows share costs one signature comparison. With 20 bands of 4, a
pair at exactly 0.8 shares no bucket with probability 3e-5. A bucket of n members that no link joins is cut into blocks of ``block``, and
each two blocks are one group of bounded size, wherever it is worked on; the pairs that such a bucket gives are those that look alike.

Edge cases: texts of fewer than five words have one shingle, all their words; a null text counts as empty, and all
texts without words of equal content are one class; class ids are the least document id, nulls aside (null only if all are null); rows that
repeat an id have classes of their own texts; a very long text is hashed in chunks and costs 16 bytes a word while it is read, and its
pairs are verified on all of it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import store
from weftline.llm.substring import window_hashes, word_hashes

SHINGLE, BANDS, ROWS = 5, 20, 4
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their weights) of a text's bytes."""
    words = word_hashes(data)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0)
    h, n = np.unique(window_hashes(words, min(SHINGLE, len(words))), return_counts=True)
    return h, 1 + np.log(n)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of ``m`` shingle hashes for each set; sets must not be empty."""
    sizes = np.array([len(h) for h, _ in sets])
    h, w = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    first, sig = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    time, state = np.zeros(len(h)), h.copy()
    while len(h):
        state += _GOLD
        a = _mix(state)
        time += -np.log1p(-(a >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        at = owner * m + (_mix(a ^ _GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        best = time == first[at]
        sig[at[best]] = h[best]
        stay = time < first.reshape(-1, m).max(1)[owner]
        h, w, owner, time, state = h[stay], w[stay], owner[stay], time[stay], state[stay]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A long for each band, which holds ``64 // rows`` bits of each of its components side by side."""
    bits = 64 // rows
    parts = (_mix(sig) >> np.uint64(64 - bits)).astype(f"<u{bits // 8}")
    return np.ascontiguousarray(parts).view("<i8").reshape(len(sig), bands)


def agreement(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The share of components in which each signature of ``a`` agrees with each of ``b``; both as ``band_keys`` gives them."""
    kind = f"<u{8 // rows}"
    x, y = a.view(kind), b.view(kind)
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for k in range(0, len(x), step):
        out[k : k + step] = (x[k : k + step, None] == y[None]).mean(2)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and probability Jaccard."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    if not len(i):
        return 0.0
    j = at[i]
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = a[1], b[1]
    if plain >= 0.95 or (x.max() == 1 and y.max() == 1):
        return plain
    ratios = np.sort(y[j] / x[i])  # for element d: 1 / sum over e of max(x_e / x_d, y_e / y_d)
    order = np.argsort(y[j] / x[i], kind="stable")
    xs, ys = x[i][order], y[j][order]
    x_low = np.concatenate(([0.0], np.cumsum(xs)))
    y_high = np.concatenate((np.cumsum(ys[::-1])[::-1], [0.0]))
    lone_x, lone_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    k = np.searchsorted(ratios, ratios, side="right")
    total = (lone_x + x_low[k]) / xs + (lone_y + y_high[k]) / ys
    return max(plain, float((1 / total).sum()))


def sketch(docs: DataFrame, doc: str, text: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, keys): the text's hash and its band keys, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = [shingles(x.as_buffer().to_pybytes()) for x in part.column(2)]
                keys: list[np.ndarray | None] = [None] * len(sets)
                order = sorted((k for k in range(len(sets)) if len(sets[k][0])), key=lambda k: len(sets[k][0]))
                group, size = [], 0
                for k in [*order, None]:
                    if group and (k is None or size > 60_000):
                        for g, row in zip(group, band_keys(signatures([sets[g] for g in group], bands * rows), bands, rows)):
                            keys[g] = row
                        group, size = [], 0
                    if k is not None:
                        group.append(k)
                        size += len(sets[k][0])
                offsets = np.cumsum([0, *(0 if k is None else bands for k in keys)])
                flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "node", "keys"])

    return nodes(docs, doc, text).select("doc_id", "node", F.col("t").cast("binary")).mapInArrow(run, "doc_id long, node binary, keys array<long>")


def nodes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.select("doc_id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("node"), "t")


def verify(pairs: DataFrame, texts: DataFrame, least: float, cached: int = 4_000_000) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough. ``cached``: shingles that a task holds of texts it may meet again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def of(node: bytes, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            found = held.get(node)
            if found is None:
                found = shingles(text.as_buffer().to_pybytes())
                if size + len(found[0]) > cached:
                    held.clear()
                    size = 0
                held[node] = found
                size += len(found[0])
            return found

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [similarity(of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])) >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("t").cast("binary").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").cast("binary").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of (a, b): the least node that it is connected to.

    Large-star and small-star rounds, each written once; the number of rounds grows as the logarithm of the longest chain.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = store.write_once(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.write_once(large.where("u != v"), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u != v").distinct()
        small = store.write_once(small, name)
        store.drop(edges, large)
        edges, after = small, state(small)
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after


def alike(members: DataFrame, rows: int, least: float, block: int = 512) -> DataFrame:
    """Pairs (a, b) of members of one bucket but of different roots whose signatures agree in a share of ``least``.

    ``members``: (band, key, node, keys, root, n), n the size of the bucket. A member is hashed to one of about n / block blocks and sent to
    each pair of blocks that has its own. A pair is given in the first band that it shares only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[pa.RecordBatch] = []
        made: list[np.ndarray] = []

        def close() -> None:
            table = pa.Table.from_batches(held)
            node = np.array(table.column(5).to_pylist(), object)
            root = np.unique(np.array(table.column(6).to_pylist(), object), return_inverse=True)[1]
            sig = table.column(7).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            side = table.column(4).to_numpy()
            left, right = (np.arange(len(node)),) * 2 if group[2] == group[3] else (np.flatnonzero(side == group[2]), np.flatnonzero(side == group[3]))
            if not len(left) or not len(right):
                return
            i, j = np.nonzero(agreement(sig[left], sig[right], rows) >= least)
            i, j = left[i], right[j]
            fit = (root[i] != root[j]) & ((i < j) if group[2] == group[3] else True)
            i, j = i[fit], j[fit]
            fit = ~(sig[i, : group[0]] == sig[j, : group[0]]).any(1)
            made.append(np.stack((node[i[fit]], node[j[fit]])))

        def out() -> pa.RecordBatch:
            a, b = np.concatenate(made, 1)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            marks = np.stack([batch.column(k).to_numpy() for k in range(4)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                now = tuple(marks[:, x].tolist())
                if held and now != group:
                    close()
                    held = []
                group = now
                held.append(batch.slice(x, y - x))
            if sum(m.shape[1] for m in made) > 10_000:
                yield out()
        if held:
            close()
        if made:
            yield out()

    blocks = F.ceil(F.col("n") / block).cast("int")
    rowed = members.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rowed = rowed.select("band", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "root", "keys")
    by = ["band", "key", "low", "high"]
    pairs = rowed.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def links(sketched: DataFrame, texts: DataFrame, least: float, rows: int = ROWS, slack: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every node that some verified link reaches, and the links (a, b)."""
    flat = sketched.dropDuplicates(["node"]).select("node", "keys", F.posexplode("keys").alias("band", "key"))
    sizes = flat.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = store.write_once(flat.select("node", "band", "key").join(sizes, ["band", "key"]), "bucket-members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = store.write_once(members.join(degree, "node"), "bucket-degrees")
    needed = texts.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    needed = store.write_once(needed, "bucket-texts")
    leaders = members.groupBy("band", "key").agg(F.max(F.struct("degree", "node")).alias("top"))
    pairs = members.join(leaders, ["band", "key"]).select("node", F.col("top.node").alias("other")).where("node != other")
    tried = store.write_once(pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), "tried")
    found = store.write_once(verify(tried, needed, least), "found", spread=True)
    roots = components(found)
    placed = members.join(roots, "node", "left").select("band", "key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "key")
    signed = sketched.dropDuplicates(["node"]).select("node", "keys")
    rest = store.write_once(placed.join(mixed, ["band", "key"]).join(signed, "node"), "mixed-buckets")
    store.drop(members)
    new = store.write_once(alike(rest, rows, least - slack).join(tried, ["a", "b"], "left_anti"), "new-pairs", spread=True)
    more = store.write_once(verify(new, needed, least), "found", spread=True)
    store.drop(rest, new, tried, needed)
    if more.isEmpty():
        return roots, found
    both = store.write_once(found.unionByName(more), "all-links")
    known = roots.select(F.col("node").alias("x"), "root")
    ends = more.join(known.withColumnsRenamed({"x": "a", "root": "ra"}), "a", "left").join(known.withColumnsRenamed({"x": "b", "root": "rb"}), "b", "left")
    upper = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    store.drop(found, more)
    lone = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    joined = roots.join(lone, "root", "full_outer").select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root"))
    return joined, both


def near_classes(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, root, class_id, class_size, n_links), a row for each row of ``docs``; ``root`` is the class's own, ``class_id``
    may be that of several; ``n_links`` counts the verified links of the row's text to other texts, those of texts that
    other links join already aside."""
    sketched = store.write_once(sketch(docs, doc, text, bands, rows), "sketches")
    roots, found = links(sketched, nodes(docs, doc, text).select("node", "t"), similarity, rows)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    marks = roots.join(degree, "node", "left")
    placed = sketched.select("doc_id", "node").join(marks, "node", "left")
    placed = store.write_once(placed.select("doc_id", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")
    store.drop(sketched)
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(classes, "root").select("doc_id", "node", "root", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, nulls last, and of rows alike in id the least text."""
    columns = docs.columns
    classes = near_classes(docs, similarity)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    row = "_row"
    while row in columns:
        row += "_"
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias(row), F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))).alias("_node"), docs["doc_id"].alias("_id"))
    ids = keyed.withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    kept = kept.select(F.col("least.node").alias("_node"), F.coalesce(F.col("least.doc_id").cast("string"), F.lit("null")).alias("_key"))
    rows = ids.join(kept, ["_node", "_key"], "left_semi")
    rows = rows.dropDuplicates(["_node", "_key"])
    return rows.select(f"{row}.*")
