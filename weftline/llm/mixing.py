"""Mixing sources to target weights by a low-discrepancy source schedule, in DataFrame operations only.

Targets share the corpus's words out by weight; one above ``repeat_cap`` times its source's words is cut to that and
the excess reshared by weight until none is above. A source's stream is its documents, shuffled by a hash of their ids and laid end
to end as often as its target asks, and stops at its target.

Slot ``i`` of the schedule lies at the golden-ratio point ``i * phi mod 1``, taken on a grid of 2^31; the cumulative
target shares map it to a source, so that every stretch of the schedule is near the target mix. The slots of a source
are ranked, and slot ``j`` is joined with the ``j``-th block of ``block`` words of its stream. What a document gives
is the sum of what its blocks hold. The schedule is within a few slots of each target: slots that find no block are left empty, and blocks
that find no slot are put behind the last one, by the rank of their source, so that a source smaller than a block is in the mix as well.

Edge cases: a null text has no words; the null source is a source, the last; a source without words gets target 0;
rows that repeat an id are documents of their own, in the order of their sizes; an empty table gives an empty mix; a very long document
is cut into blocks as any other; other columns pass through
``mix`` untouched, whatever their names, as the working columns live in a struct of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm import store

GRID_BITS, CELL_BITS, PHI = 31, 10, 1327217885
BLOCK = 1024
#: Rows that one window task orders at most, about: of slots of a source, of documents of a source.
SLOTS_A_RANGE, DOCS_A_BUCKET = 1 << 16, 1 << 15


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key(source: Column) -> Column:
    """One string a source, the null source included, so that joins are on plain equality."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat_cap: int = 3) -> DataFrame:
    """(key, source, rank, source_size, target) from (source, size): one row a source.

    The windows run over one row a source. A source is capped exactly if its cap per weight is below the common
    level, so with sources in the order of cap per weight one pass of running sums finds that level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double")
    ranked = ranked.withColumns({"weight": weight, "cap": (F.col("source_size") * repeat_cap).cast("double")})
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("common", F.max(fits).over(everything))
    return ranked.select(key(F.col("source")).alias("key"), "source", "rank", "source_size", F.least("cap", F.coalesce("common", F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(goal: DataFrame, slots: int) -> DataFrame:
    """(slot, key): which source each of ``slots`` slots of the mix draws from. ``goal``: the rows of ``targets``.

    A slot and a source's interval of the grid meet in one of 2^10 cells, so the range join is an equality join on
    the cell and a comparison.
    """
    spark = goal.sparkSession
    order = Window.partitionBy(F.lit(0)).orderBy("rank")
    grid = float(1 << GRID_BITS)
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.greatest(F.sum("target").over(Window.partitionBy(F.lit(0))), F.lit(1.0))
    spans = goal.withColumn("high", F.least(F.lit(grid), F.round(upto / whole * grid)).cast("long"))
    spans = spans.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0).cast("long"))).where("high > low")
    shift = GRID_BITS - CELL_BITS
    cells = spans.select("key", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    slots = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % (1 << GRID_BITS) * PHI % (1 << GRID_BITS)).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", shift))
    return slots.join(cells, "cell").where("point >= low and point < high").select("slot", "key")


def ranked_slots(goal: DataFrame, slots: int, block: int) -> DataFrame:
    """(key, j, slot): the slot of each source's ``j``-th block. ``goal`` has ``stream``, the words that each source gives.

    Slots of a source are ranked within ranges of the schedule, to which the counts of the ranges before are added, so a source that holds
    most slots is not ordered in one task.
    """
    ranged = schedule(goal, slots).withColumn("range", F.floor(F.col("slot") / SLOTS_A_RANGE))
    parts = ranged.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.write_once(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-ranges")
    inside = F.row_number().over(Window.partitionBy("key", "range").orderBy("slot")) - 1
    found = ranged.withColumn("r", inside).join(parts, ["key", "range"]).select("key", (F.col("r") + F.col("base")).alias("j"), "slot")
    have = parts.groupBy("key").agg(F.sum("n").alias("have"))
    lacking = goal.join(have, "key", "left").select("key", "rank", F.ceil(F.col("stream") / block).alias("need"), F.coalesce("have", F.lit(0)).alias("have")).where("need > have")
    by_rank = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    lacking = lacking.withColumn("base", F.lit(slots) + F.coalesce(F.sum(F.col("need") - F.col("have")).over(by_rank), F.lit(0)))
    tail = lacking.select("key", "base", "have", F.explode(F.expr("sequence(have, need - 1)")).alias("j")).select("key", "j", (F.col("base") + F.col("j") - F.col("have")).alias("slot"))
    return found.unionByName(tail)


def blocks(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat_cap: int = 3, block: int = BLOCK, doc: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix itself, and the documents that it is drawn from.

    (row, lap, slot, first, upto): the words of each document that each slot takes, ``lap`` telling the copies of one apart; and
    (row, doc_id, size, source_size, target, pos). ``row``: a column that tells rows apart, made here if not named; ``pos`` is a
    document's first word in its source's stream: a running sum within hash buckets of each source, plus those of the
    buckets before, so no task orders a whole source.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    sizes = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), number.alias("row"))
    sizes = store.write_once(sizes, "mix-sizes")
    goal = targets(sizes, weights, repeat_cap).withColumn("stream", F.round("target").cast("long"))
    goal = store.write_once(goal, "mix-targets")
    total, n = goal.agg(F.sum("stream")).first()[0] or 0, sizes.count()

    digits = 1
    while n > DOCS_A_BUCKET * 16**digits:
        digits += 1
    at = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = sizes.select("row", "doc_id", "size", key(F.col("source")).alias("key"), at.alias("at")).withColumn("bucket", F.substring("at", 1, digits))
    parts = rows.groupBy("key", "bucket").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "bucket", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, ["key", "bucket"]).join(goal.select("key", "source_size", "target", "stream"), "key")
    placed = rows.select("row", "doc_id", "size", "key", "source_size", "target", "stream", (F.col("base") + F.col("ahead")).alias("pos"))
    placed = store.write_once(placed, "mix-places")
    store.drop(sizes)

    laps = placed.where("size > 0 and pos < stream").withColumn("lap", F.explode(F.expr("sequence(0, (stream - 1 - pos) div source_size)")))
    start = F.col("lap") * F.col("source_size") + F.col("pos")
    laps = laps.select("row", "key", "lap", start.alias("start"), F.least(start + F.col("size"), F.col("stream")).alias("stop"))
    cut = laps.withColumn("j", F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")))
    first, upto = F.greatest(F.lit(0), F.col("j") * block - F.col("start")), F.least(F.col("stop"), (F.col("j") + 1) * block) - F.col("start")
    slots = ranked_slots(goal, -(-total // block), block)
    return cut.join(slots, ["key", "j"]).select("row", "lap", "slot", first.alias("first"), upto.alias("upto")), placed


def takes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat_cap: int = 3, block: int = BLOCK, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, key, source_size, target, taken, first_slot): a row for each row of ``docs``; ``first_slot`` is null where nothing is taken."""
    made, placed = blocks(docs, weights, repeat_cap, block, doc, text, source)
    sums = made.groupBy("row").agg(F.sum(F.col("upto") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(sums, "row", "left").select("doc_id", "size", "key", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat_cap: int = 3, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix holds them, same columns, in the order of the schedule: each document as often as it is taken whole, at the slot
    of its copy's first block, and once cut to its first words where its source's stream ends inside it. Documents that aren't taken go."""
    columns = docs.columns
    name = "_mix"
    while name in columns:
        name += "_"
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias(name))
    rows = store.write_once(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    made, placed = blocks(rows.select(*[F.col(f"{name}.{c}").alias(c) for c in ("doc_id", "text", "source")], "_row"), weights, repeat_cap, block, row="_row")
    plan = made.groupBy("row", "lap").agg(F.sum(F.col("upto") - F.col("first")).alias("_cut"), F.min("slot").alias("_slot"))
    plan = plan.join(placed.select("row", "size", "pos"), "row").withColumnRenamed("row", "_row")
    joined = rows.join(plan, "_row")
    each = F.regexp_extract_all(F.col(f"{name}.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    body = F.when(F.col("_cut") < F.col("size"), F.array_join(F.slice(each, F.lit(1), F.col("_cut").cast("int")), "")).otherwise(F.col(f"{name}.text"))
    kinds = {f.name: f.dataType for f in docs.schema}
    out = {c: F.col(f"{name}.`{c}`") for c in columns} | {"text": body}
    if "n_chars" in kinds:
        out["n_chars"] = F.when(F.col("_cut") < F.col("size"), F.length(body).cast(kinds["n_chars"] if not isinstance(kinds["n_chars"], T.NullType) else "long")).otherwise(F.col(f"{name}.n_chars"))
    return joined.repartitionByRange("_slot").sortWithinPartitions("_slot", "lap", "pos").select(*[v.alias(c) for c, v in out.items()])
