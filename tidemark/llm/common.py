"""Helpers shared by the text operators: Arrow plumbing and shared storage."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; temporary arrays are a small multiple of it.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set by Spark's own reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session that has none set gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, hint: str = "t") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = end


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once a task, for what is costly to load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield from step(batch)
                trim()

    return df.mapInArrow(run, schema)


def doc_hash(column: str = "doc_id"):
    """CRC-32 of the id's decimal text: what decides folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fresh(df: DataFrame, *hints: str) -> list[str]:
    """Column names for passing use that df doesn't have (whatever the case of letters), one for each hint."""
    own, out = {c.lower() for c in df.columns}, []
    for hint in hints:
        name, k = f"_{hint}", 0
        while name.lower() in own:
            name, k = f"_{hint}{k}", k + 1
        own.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, bytes_a_row: int, limit: int) -> bool:
    """Whether df surely stays under a limit of bytes; counts it."""
    return df.count() * bytes_a_row <= limit


def sampled(key: str, share, salt: int):
    """Condition that keeps about a share (a column or number) of rows, by the key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)


_made: dict[str, object] = {}


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size, with a name by which workers keep what they make of it."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


def made(shared, make: Callable):
    """make(value) of a value that share() sent, once a Python worker; only the latest is kept."""
    name, value = shared.value
    if name not in _made:
        _made.clear()
        _made[name] = make(value)
    return _made[name]
