"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of the batches that go to Python workers.
BATCH_BYTES = 8 << 20
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a table that may be broadcast: some 16 MB of keys.
SMALL_ROWS = 500_000
#: Bytes of text that a kernel takes up at a time; as lists of words they need some twenty times as much.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "rangescan-shared")
        os.makedirs(path, exist_ok=True)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """Path of a folder in the shared one that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage, survives lost executors.

    The shuffle files of the job go when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for tables that no later job reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that lead to a result, deleted together once that has been written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(cut(df, label))
        return self.tables[-1]

    def discard(self) -> None:
        discard(*self.tables)
        self.tables = []


def small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches of at most BATCH_BYTES in this session, unless another bound than Spark's own is set."""
    if spark.conf.get(_BATCH, None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that may be remote; runs on executors."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text counts as empty. Other columns can't clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return raw(batch.column(batch.schema.get_field_index(name)))


#: Tables that a worker keeps from text to text; the end of a task empties them.
worker_caches: list[dict] = []


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: workers live on from stage to stage."""
    for cache in worker_caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def sliced(batches: Iterable[pa.RecordBatch], name: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``most`` bytes of a text column; a longer text is a piece of its own."""
    try:
        yield from _slices(batches, name, most or SLICE_BYTES)
    finally:
        tidy()


def _slices(batches: Iterable[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends, at = np.cumsum(np.asarray(sizes), dtype=np.int64), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def groups(batches: Iterable[pa.RecordBatch], keys: int, arrow: bool = False) -> Iterator:
    """Columns (or, with ``arrow``, batches) of a stream sorted by its first ``keys`` columns, in pieces that hold whole groups.

    What waits for the end of a group is put together once, so a long group costs no more than its rows.
    """
    try:
        yield from _groups(batches, keys, arrow)
    finally:
        tidy()


def _groups(batches: Iterable[pa.RecordBatch], keys: int, arrow: bool) -> Iterator:
    held: list[pa.RecordBatch] = []

    def out():
        whole = pa.concat_batches(held) if len(held) > 1 else held[0]
        return whole if arrow else [np.asarray(c) for c in whole.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns[:keys]]
        start = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in cols])))  # the last group begins here
        if held and (start or any(c[0] != h[-1].as_py() for c, h in zip(cols, held[-1].columns[:keys], strict=True))):
            if start:
                held.append(batch.slice(0, start))
            yield out()
            held = []
        elif start:
            held.append(batch.slice(0, start))
            yield out()
            held = []
        held.append(batch.slice(start))
    if held:
        yield out()


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
