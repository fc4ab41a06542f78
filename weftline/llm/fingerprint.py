"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs (lines with a word). Each paragraph gives a vector: 16 lanes of 32 bits from
a SHA-512 of it, and 64 signed lanes that count the hashes of its three-word shingles. A document's fingerprint is the sum of
its paragraphs' vectors, all lanes modulo 2^32, which no text's counts of shingles reach. Hence equal texts, and texts that
differ in the order of paragraphs only, have equal fingerprints; a paragraph is inserted or deleted by adding or
subtracting its vector (``combine``); and the likeness of two fingerprints is the cosine of their shingle lanes, near the share
of shingles that they have in common.

Edge cases: a null text counts as empty and has the zero vector; texts without a word are all alike (likeness 1), and
unlike any text with one (0); a null id comes last in the order; rows that repeat an id follow each other in the
order of their texts; a very long text is split and summed in one task, in memory some ten times its size; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import store

LANES, SHINGLES = 16, 64
BLANK = r"[\x20\x09-\x0D]+"


def sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``exact`` and ``near``, arrays of the lanes of ``text``; a row for each value of the keys.

    Paragraphs and shingles are exploded and summed inside the task that read the text; only lanes leave it, and
    none do where the rows are already partitioned by some of the keys.
    """
    paragraphs = rows.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("p"))
    w = paragraphs.select(*keys, F.trim(F.regexp_replace("p", BLANK, " ")).alias("p")).select(*keys, "p", F.split("p", " ").alias("w"))
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))
    units = w.select(*keys, "p", F.posexplode(zipped).alias("i", "z"))
    units = units.select(*keys, F.when((F.col("i") == 0) & (F.col("p") != ""), F.sha2("p", 512)).alias("d"), F.when(F.col("p") != "", F.xxhash64("z.a", "z.b", "z.c")).alias("h"))
    units = units.select(*keys, "d", F.col("h").bitwiseAND(SHINGLES - 1).alias("lane"), (F.shiftright("h", 20).bitwiseAND(2) - 1).alias("sign"))
    exact = [F.sum(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"x{k}") for k in range(LANES)]
    near = [F.sum(F.when(F.col("lane") == k, F.col("sign")).otherwise(F.lit(0))).alias(f"n{k}") for k in range(SHINGLES)]
    out = units.groupBy(*keys).agg(*exact, *near)
    zero = F.lit(0).cast("long")
    return out.select(
        *keys,
        F.array(*[F.coalesce(F.col(f"x{k}"), zero).bitwiseAND((1 << 32) - 1) for k in range(LANES)]).alias("exact"),
        F.array(*[F.pmod(F.coalesce(F.col(f"n{k}"), zero) + (1 << 31), F.lit(1 << 32)) - (1 << 31) for k in range(SHINGLES)]).alias("near"),
    )


def digest(exact: Column, near: Column) -> Column:
    """Both vectors in hexadecimal: 128 and 512 digits."""
    lane = lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 32)))), 8, "0")
    return F.array_join(F.transform(F.concat(exact, near), lane), "")


def combine(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """The lanes of two multisets put together (sign 1), or of the first without the second (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(exact_a: Column, near_a: Column, exact_b: Column, near_b: Column) -> Column:
    """0 to 1; 1 for equal vectors, 0 where only one is the zero vector."""
    scale = F.sqrt(_dot(near_a, near_a) * _dot(near_b, near_b))
    return F.when((exact_a == exact_b) & (near_a == near_b), F.lit(1.0)).when(scale == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(near_a, near_b) / scale)))


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, exact, near), one row for each row of ``docs``."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("r"))
    return sums(rows, ["doc_id", "r"], "t").select("doc_id", digest(F.col("exact"), F.col("near")).alias("fingerprint"), "exact", "near")


def neighbours(docs: DataFrame, doc: str = "doc_id", text: str = "text", rows_per_bucket: int = 800) -> tuple[DataFrame, DataFrame]:
    """(bucket, rn, doc_id, t, next), every text with that of the next document by ascending id, cyclically; and (bucket, following),
    the text that comes after the last of each bucket.

    The ids are cut into ranges at approximate quantiles; texts move once, to their range, where a window finds the
    next; only a range's last row looks into another, through the second table of one row a range.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = rows.select(F.count("*")).first()[0]
    cuts = max(1, min(20_000, math.ceil(n / rows_per_bucket)))
    marks = rows.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)] or [0.5], 10 * max(1000, cuts))).first()[0] or []
    marks = sorted({int(x) for x in marks})
    wide = max(1, math.isqrt(len(marks)))
    groups = [marks[k : k + wide] for k in range(0, len(marks), wide)]
    if groups:
        outer = F.greatest(F.size(F.filter(F.lit([g[0] for g in groups]).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))), F.lit(1))
        inner = F.element_at(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), outer)
        at = (outer - 1) * wide + F.size(F.filter(inner, lambda x: x <= F.col("doc_id")))
    else:
        at = F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(marks) + 1)).otherwise(at).cast("int"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "t")
    ranged = rows.withColumns({"rn": F.row_number().over(order), "next": F.lead("t").over(order)})
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "t")).alias("first")).select("bucket", F.col("first.t").alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("bucket")
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(whole), F.first_value("first").over(whole)).alias("following"))
    firsts = store.write_once(firsts, "range-firsts")
    return ranged.join(firsts, "bucket").select("bucket", "rn", "doc_id", "t", F.coalesce("next", "following").alias("next")), firsts


def with_edits(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text, whose last quarter is replaced by as much of the next
    document's beginning, and its likeness to that and to the next document's. The next document's lanes are those of the next row."""
    rows, firsts = neighbours(docs, doc, text)
    n = F.length("t")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    kept = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("t", "edited")).alias("k", "text"))
    lanes = sums(texts, [*kept, "k"], "text")
    pick = [F.max(F.when(F.col("k") == k, F.struct("exact", "near"))).alias(f"v{k}") for k in range(2)]
    both = lanes.groupBy("bucket", "rn").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"), *pick)
    both = both.withColumn("lead", F.lead("v0").over(Window.partitionBy("bucket").orderBy("rn")))
    last = sums(firsts, ["bucket"], "following").select("bucket", F.struct("exact", "near").alias("beyond"))
    both = both.join(last, "bucket").withColumn("v2", F.coalesce("lead", "beyond"))
    v = [(F.col(f"v{k}.exact"), F.col(f"v{k}.near")) for k in range(3)]
    return both.select("doc_id", "n_chars", "edited_sha256", digest(*v[0]).alias("fingerprint"), digest(*v[1]).alias("edited_fingerprint"), likeness(*v[0], *v[1]).alias("near_edited"), likeness(*v[0], *v[2]).alias("near_next"))
