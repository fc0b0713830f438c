"""What the operators share about the session: checkpoints, table reads, null-safe text."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch. Workers hold some batches and what is made from them; JVMs hold the same outside the heap.
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python functions to ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(columns: list[str], name: str) -> str:
    """``name``, or one made from it that no column has."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def columns_named(columns: list[str]) -> list[Column]:
    """The columns of these names, which may hold dots."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, shared by the cluster.

    Only a single-process local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


#: Paths of the tables written in each scope that is open, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables ``written`` inside are deleted at the end, but for those written with ``keep``."""
    held = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        for path in _scopes.get()[-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _scopes.reset(held)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, cutting its lineage.

    The columns are compressed, and later steps read only those that they name. Spark deletes the
    shuffle files of a cut lineage once the driver's collector has found it unused, which a quiet
    driver may put off for half an hour; so the driver collects first. The table lasts as long as the
    innermost ``scratch``, or the one around it where it is to be kept.
    """
    _collect_lineage(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    depth, scopes = 2 if keep else 1, _scopes.get()
    if len(scopes) >= depth:
        scopes[-depth].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _collect_lineage(spark: SparkSession) -> None:
    shared_folder(spark)
    small_batches(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a narrow table that every executor may hold: below 70 MB as Spark keeps them, by the largest measured.
BROADCAST_ROWS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, weight: Column | None = None) -> DataFrame:
    """Join wide rows with a narrow written table, without a shuffle of the wide rows where its size allows.

    ``ids`` is counted (or its ``weight`` summed); up to ``BROADCAST_ROWS`` it is broadcast, beyond
    that both sides are shuffled by key.
    """
    size = ids.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return df.join(F.broadcast(ids) if size <= BROADCAST_ROWS else ids, key, how)


def release_memory() -> None:
    """Hand freed memory back to the system: Python workers stay for later tasks, and what they keep counts with the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run`` over a task's batches, handing freed memory back at its end."""

    def wrapped(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        release_memory()

    return wrapped
