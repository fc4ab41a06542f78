"""Items on their way to sinks: routing, statement groups, write modes and rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("insert", "ignore_insert", "update_insert")


def insert(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch, allowMissingColumns=True)


def ignore_insert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new keys are appended, the first of each key in the batch."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def update_insert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], fields: list[str] | None = None) -> DataFrame:
    """The last row of each key in the batch updates ``fields``, all by default, of the row that is there, or is new."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("new"))
    fields = fields or [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*target.columns).alias("old"))
    joined = old.join(last, keys, "full_outer")
    pick = lambda c: F.when(F.col("old").isNull(), F.col(f"new.{c}")).when(F.col("new").isNull() | F.lit(c not in fields), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in target.columns])


def writer(mode: str) -> Callable[..., DataFrame]:
    return {"insert": insert, "ignore_insert": ignore_insert, "update_insert": update_insert}[mode]


def statement_groups(items: DataFrame) -> DataFrame:
    """Items of one statement shape each: grouped by the parts themselves, so no two shapes can share a key."""
    shape = ["fields", "update_fields", "alias", "mode", "table_name", "on_conflict"]
    return items.groupBy(*shape).agg(F.count("*").alias("n"))


def flushes(items: DataFrame, size: int, order: list[str], shape: list[str] | None = None, buckets: int = 1) -> DataFrame:
    """Items with ``flush``, the number of the batch of their statement shape: ``size`` items fill one.

    ``buckets``: writers that each fill batches of their own, so that a shape that most items have is not numbered in one task.
    """
    by = shape or ["fields", "update_fields", "alias", "mode", "table_name", "on_conflict"]
    marked = items.withColumn("writer", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy(*by, "writer").orderBy(*order))
    return marked.withColumn("flush", F.floor((rank - 1) / size).cast("long"))


def with_sinks(items: DataFrame, sinks: DataFrame, alias: str = "alias") -> DataFrame:
    """Items with the settings of the sink that they name; an unknown name is an error row. ``sinks`` is a small table of settings."""
    known = sinks.withColumn("_known", F.lit(True))
    joined = items.join(known, alias, "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("no sink "), F.coalesce(F.col(alias), F.lit("null"))))).drop("_known")


def documents(items: DataFrame, columns: list[str]) -> DataFrame:
    """Items as JSON documents, as a store of documents takes them in bulk; nulls are kept."""
    return items.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"))


def commands(items: DataFrame, method: str, key: str, columns: list[str]) -> DataFrame:
    """(method, key, value): what is sent to a key-value store; a set takes each value once."""
    rows = items.select(F.lit(method).alias("method"), F.lit(key).alias("key"), F.to_json(F.struct(*columns)).alias("value"))
    return rows.distinct() if method.lower() == "sadd" else rows


def published(requests: DataFrame, payload: Column, most: int = 255) -> DataFrame:
    """(payload, priority, persistent): messages for a broker, whose priorities are from 0 to ``most``."""
    return requests.select(payload.alias("payload"), F.greatest(F.lit(0), F.least(F.lit(most), F.col("priority"))).cast("int").alias("priority"), F.lit(True).alias("persistent"))


LINES = {
    "crawled": "Crawled (%s) <%s %s> (referer: %s)",
    "scraped": "Scraped from <%s %s>\n%s",
    "dropped": "Dropped: %s\n%s",
    "item_error": "Error processing %s",
    "spider_error": "Spider error processing <%s %s> (referer: %s)",
    "download_error": "Error downloading <%s %s>: %s",
}


def log_line(kind: str, *values: Column) -> Column:
    """One line of the log; what is null reads None."""
    return F.format_string(LINES[kind], *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])


def merged(target: DataFrame | None, batch: DataFrame, mode: str, keys: list[str], order: list[str], fields: list[str] | None = None) -> DataFrame:
    """The table after a batch was written in one of ``MODES``; without a table yet, after the batch alone."""
    if target is None:
        target = batch.limit(0)
    if mode == "insert":
        return insert(target, batch)
    return ignore_insert(target, batch, keys, order) if mode == "ignore_insert" else update_insert(target, batch, keys, order, fields)


def table_sink(folder: str, mode: str, keys: list[str], order: list[str], fields: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps a table in versions, one a batch, under a write mode.

    A batch reads the newest version before its own number and writes its own, so one that comes again writes the same once more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = [v for v in versions(spark, folder) if v < batch_id]
        target = spark.read.parquet(f"{folder}/version={old[-1]}") if old else None
        merged(target, batch, mode, keys, order, fields).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return write


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions in a folder of ``table_sink``, in order."""
    files, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
    done = [f.path for f in found if f.base_name == "_SUCCESS"]
    return sorted(int(x.rpartition("version=")[2].split("/")[0]) for x in done if "version=" in x)


def stored(items: DataFrame, route: str = "route") -> DataFrame:
    return items.where(F.col(route).isNotNull())


def fan_out(items: DataFrame, aliases: Column) -> DataFrame:
    """A row for each database that an item goes to."""
    return items.withColumn("alias", F.explode(aliases))


def rejects(items: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with the first rule that applies as ``reason``)."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules.items()])
    marked = items.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def write_csv(items: DataFrame, path: str) -> None:
    """A header of all columns; values are aligned by name."""
    items.write.mode("overwrite").option("header", True).csv(path if path.endswith(".csv") else path + ".csv")


def statement(dialect: str, mode: str, table: str, columns: list[str], keys: list[str] | None = None, fields: list[str] | None = None) -> str:
    """The SQL of a write mode with a mark for each value, for databases that take it."""
    mark = "%s"
    quote = (lambda c: f"`{c}`") if dialect == "mysql" else (lambda c: f'"{c}"')
    into = f"INTO {quote(table)} ({', '.join(map(quote, columns))}) VALUES ({', '.join([mark] * len(columns))})"
    fields = fields or [c for c in columns if c not in (keys or [])]
    if mode == "insert":
        return f"INSERT {into}"
    if mode == "ignore_insert":
        return f"INSERT IGNORE {into}" if dialect == "mysql" else f"INSERT {into} ON CONFLICT DO NOTHING"
    if mode != "update_insert":
        raise ValueError(f"no such mode: {mode}")
    if dialect == "mysql":
        return f"INSERT {into} ON DUPLICATE KEY UPDATE " + ", ".join(f"{quote(c)} = VALUES({quote(c)})" for c in fields)
    return f"INSERT {into} ON CONFLICT ({', '.join(map(quote, keys or []))}) DO UPDATE SET " + ", ".join(f"{quote(c)} = EXCLUDED.{quote(c)}" for c in fields)


def write_statements(items: DataFrame, connect: Callable[[], object], sql: str, batch: int = 500) -> None:
    """Runs a statement for the rows of every partition through a DB-API connection of its own, ``batch`` rows at a time; each batch is one transaction."""

    def run(batches):
        import pyarrow as pa

        connection = connect()
        n = 0
        try:
            for part in batches:
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                for k in range(0, len(rows), batch):
                    connection.cursor().executemany(sql, rows[k : k + batch])
                    connection.commit()
                n += len(rows)
        finally:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    items.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write_jdbc(items: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    items.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def append_seen(new: DataFrame, path: str, key: str = "fp") -> None:
    new.select(key).write.mode("append").text(path)


def write_to_all(batch: DataFrame, sinks: list[Callable[[DataFrame], None]], attempts: int = 3, retry_on: Callable[[Exception], bool] = lambda e: False) -> None:
    """One batch to several sinks. A sink is tried again while the error is of a kind to retry; the batch is kept until all are done."""
    held = batch.persist()
    try:
        for sink in sinks:
            for k in range(attempts):
                try:
                    sink(held)
                    break
                except Exception as e:
                    if k + 1 == attempts or not retry_on(e):
                        raise
    finally:
        held.unpersist()


def connection_error(error: BaseException | None, codes: tuple[int, ...] = (2002, 2003, 2006, 2013)) -> bool:
    """Whether the error or one that it came from is of the connection: by class, or by a database's error number."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if isinstance(error, (ConnectionError, TimeoutError)) or (error.args and error.args[0] in codes):
            return True
        error = error.__cause__ or error.__context__
    return False
