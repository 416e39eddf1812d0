"""What the operators of this subpackage share: reading, Arrow functions over text, shared storage."""

from __future__ import annotations

import ctypes
import glob
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Upper-case ASCII letters become lower-case, every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no letter becomes a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A batch of texts given to one call of a kernel holds about so many bytes; a longer text is a batch of its own.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose ASCII letters are lower-cased (bytes.split cuts at just these)."""
    return text.translate(LOWER).split()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts of an Arrow string array as UTF-8 bytes (null: empty), in lists of bounded size."""
    array = array.cast(pa.binary()) if not pa.types.is_binary(array.type) else array
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(array):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield [x or b"" for x in array.slice(start, stop - start).to_pylist()]
        start = stop


def text_udf(make: Callable[[], Callable[[list[bytes]], list]], returns: T.StructType, slice_bytes: int = SLICE_BYTES) -> Callable[[Column], Column]:
    """An Arrow function from a text column to a struct.

    ``make`` runs once in each task and gives the kernel: UTF-8 texts in, one list of values per field out.
    Other columns of the row never leave the JVM, so their names and types do not matter.
    """
    arrow = [to_arrow_type(f.dataType) for f in returns]
    names = returns.names

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make()
        for batch in batches:
            parts = [
                pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(kernel(texts), arrow, strict=True)], names=names)
                for texts in slices(batch, slice_bytes)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, arrow, strict=True))))

    return run


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def with_fields(df: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """Columns ``keep`` and the fields of a struct, evaluated once."""
    return df.select(*keep, value.alias("__r")).select(*keep, "__r.*")


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives the value in any task. Its size must be bounded.

    What is broadcast are bytes that hold the classes of this package by value, as executors need not have it installed.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def one_thread() -> bool:
    """Let numpy's products use one thread; whether that could be set.

    Spark runs a task a core, and helper threads that wait for the next small product take up as much time as the work.
    """
    done = False
    for path in glob.glob(f"{os.path.dirname(os.path.dirname(np.__file__))}/numpy.libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
                break
    return done


def give_back() -> None:
    """Let glibc return freed memory to the system, and from now on large arrays at once; workers live on beside other tasks."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt") and hasattr(library, "malloc_trim"):
        library.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        library.malloc_trim(0)


def whole_rows() -> Column:
    """The row as one struct, whatever the names of its columns."""
    return F.struct(F.col("*")).alias("__doc")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is local one of this machine (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = found.get() if found.isDefined() else f"file://{tempfile.gettempdir()}/keyloom-checkpoints-{os.getuid()}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame's rows in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again; for frames of which later steps read single columns, or parts ``by`` a value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
