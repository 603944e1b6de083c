"""Shared folder, written tables, broadcasts of measured size, and slices of batches for the operators here."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many bytes, by measured_bytes().
MOST_BROADCAST = 32 << 20
#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own).
SLICE = 2_000_000
#: After so many bytes of texts, free memory of the Python process goes back.
GIVE_BACK = 16_000_000
#: Rows of a batch between Spark and Python, where the session keeps Spark's own 10,000: texts are long rows.
BATCH_ROWS = 1000
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session (tests) may go without: it gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _stash().setdefault("dir", None) or tempfile.mkdtemp(prefix="scriptorium-")
        _stash()["dir"] = found
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows from now on, unless the session says otherwise."""
    if spark.conf.get(ROWS_KEY) == "10000":
        spark.conf.set(ROWS_KEY, BATCH_ROWS)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here.

    The table survives lost executors; it is deleted when the application ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(F.transform(value, lambda x: _bytes(x, kind.elementType)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of all rows of df in memory."""
    one = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return df.agg(F.sum(one).alias("n")).first().n or 0


def sized(df: DataFrame, limit: int = MOST_BROADCAST) -> DataFrame:
    """df (a written table, or little work on one) marked for broadcast where its measured bytes stay within limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stash() -> dict:
    """A dict that lives as long as this Python process, also where this module was pickled by value."""
    return sys.modules.setdefault("_scriptorium_stash", types.ModuleType("_scriptorium_stash")).__dict__


def kept(key: str, make):
    """make() once for each Python process."""
    stash = _stash()
    if key not in stash:
        stash[key] = make()
    return stash[key]


def forget(*keys: str) -> int:
    """Drops what this Python process keeps for its tasks under other keys than these; how much that was."""
    stash = _stash()
    gone = [k for k in stash if ":" in k and k not in keys]
    for k in gone:
        del stash[k]
    return len(gone)


def give_back() -> None:
    """Free memory of this Python process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], *keys: str) -> Callable[[Iterator], Iterator]:
    """run for one task: what earlier operators keep in this worker goes first (but for keys), and free memory is given back at the end."""

    def task(batches: Iterator) -> Iterator:
        if forget(*keys):
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of that column's texts; memory follows bytes, not rows."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches anew, each of about `most` bytes of that column's texts, whatever sizes they came in."""
    held: list[pa.RecordBatch] = []
    size = made = 0
    for big in batches:
        for b in slices(big, column, most):
            n = pc.sum(pc.binary_length(b.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, made = [], 0, made + size
                if made > GIVE_BACK:
                    made = 0
                    give_back()
            if b.num_rows:
                held.append(b)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8) of all texts end to end (nulls: none; a copy), and the borders of each text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    borders = np.append(0, np.cumsum(sizes))
    first = texts.offset
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = int(np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[first]) if len(texts) else 0
    data = texts.buffers()[2] if len(texts) else None
    return np.frombuffer(data or b"", np.uint8)[at : at + borders[-1]].copy(), borders
