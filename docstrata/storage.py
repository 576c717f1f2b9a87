"""Results that are written once and read by several steps, in the folder that the cluster shares.

What was written goes when its reader is done: inside ``intermediates``, at its end; with ``release``, at once; the rest, which a
result that has not been read yet may still need, with the application.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, on one machine only: elsewhere executors would write to disks of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="docstrata-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; one that is not there has none."""
    target, files = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """One small file, or None if it is not there."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written over."""
    target, files = _path(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; one that is gone is no error."""
    _written.pop(path, None)
    target, files = _path(spark, path)
    files.delete(target, True)


def _drop_rest() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the application may have ended before
            if spark.sparkContext._jsc is not None:
                drop(spark, path)


def note(spark: SparkSession, path: str) -> str:
    """Remember a folder for deletion."""
    if not _written:
        atexit.unregister(_drop_rest)
        atexit.register(_drop_rest)
    _written[path] = spark
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return note(spark, f"{shared_dir(spark)}/docstrata/{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def intermediates():
    """What is materialized inside goes at the end: for work whose result has been written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path, spark in list(_written.items()):
            if path not in before:
                drop(spark, path)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go once it has run; its result is on shared storage by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema (empty tables too)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file bytes for a scan); no job runs. Unknown sizes count as nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def dealt(df: DataFrame, parts: int, *keys: Column | str) -> DataFrame:
    """Rows dealt out by keys: to ``parts`` tasks if those are more than a shuffle has, so that what one holds is bounded; else as Spark does it."""
    more = parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if more else df.repartition(*keys)


def release(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [p for p in _written if path.endswith(p.split(":", 1)[-1].lstrip("/"))]:
            drop(df.sparkSession, known)
