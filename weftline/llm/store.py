"""Tables written once in the shared folder, so that a lost executor costs a re-read and not a recomputation.

A table lasts until ``drop`` deletes it, until the ``scope`` it was written in ends, or until the driver's Python process ends,
on clusters as well; nothing else deletes one, so a DataFrame over it stays good while other operators run.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
_own: dict[str, str] = {}
_written: set[str] = set()
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without that setting, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def folder(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below the shared folder; nothing is created yet."""
    path = f"{base(spark)}/weftline/{uuid.uuid4().hex}-{name}"
    _written.add(path)
    held = _scope.get()
    if held is not None:
        held.append(path)
    return path


def write_once(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: computed exactly once, with its lineage cut.

    The shuffle files of the writing are deleted with it, as nothing can ask for them again. ``spread``: small partitions
    are left apart, for work that costs much time for few bytes.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    with _set(spark, {CLEANUP: "true"} | ({COALESCE: "false"} if spread else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    known = {k: v for k, v in before.items() if v is not None}
    for k in known:
        spark.conf.set(k, settings[k])
    try:
        yield
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``write_once`` that nothing reads any more."""
    for df in tables:
        _delete(df._written)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, what was written inside and by no other caller."""
    token = _scope.set([])
    try:
        yield
    finally:
        held = _scope.get()
        _scope.reset(token)
        for path in held:
            _delete(path)


def _delete(where: str) -> None:
    if where in _written:
        _written.discard(where)
        files, path = filesystem(where)
        if files.get_file_info(path).type != pafs.FileType.NotFound:
            files.delete_dir(path)


@atexit.register
def _clear() -> None:
    for path in list(_written):
        with contextlib.suppress(OSError):
            _delete(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
