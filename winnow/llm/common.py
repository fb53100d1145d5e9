"""Helpers that several operators share: scratch tables, column names, text chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a task holds at a time. One longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000


#: Where the names of new scratch folders are noted, if anybody asks.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder name that driver and executors share, under spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="winnow-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def noting() -> Iterator[list[str]]:
    """The scratch folders that are named while this lasts."""
    names: list[str] = []
    before = _noted.set(names)
    try:
        yield names
    finally:
        _noted.reset(before)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete scratch folders, through Hadoop's file system: they may be anywhere."""
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """The same rows from a written table: computed once, with no lineage to recompute."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with about `limit` bytes of text, and these texts."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64) + np.arange(1, len(sizes) + 1)
        first = before = 0
        while first < batch.num_rows:
            last = min(int(np.searchsorted(upto, before + limit)) + 1, batch.num_rows)
            part = batch.slice(first, last - first)
            yield part, text_bytes(part.column(place))
            first, before = last, int(upto[last - 1])


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, TypeError, AttributeError):  # glibc has it, others need it less
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when its task ends. A worker waits for
    its next task; what it holds then is missing to stages that run no Python."""

    @wraps(run)
    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def settle_by(df: DataFrame, key: str, parts: int, spread: bool = True) -> DataFrame:
    """The same rows from a table that is stored in `parts` buckets of a key: joins on the key
    need not shuffle it. Only the files are kept, in the scratch folder; the name goes at once.
    Rows that are dealt out by the key already need not be spread again."""
    spark = df.sparkSession
    name = f"winnow_{uuid.uuid4().hex}"
    writer = (df.repartition(parts, key) if spread else df).write.bucketBy(parts, key).option("path", scratch(spark)).option("compression", "zstd")
    writer.saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return stored
