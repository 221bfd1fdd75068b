"""What the operators of this subpackage share: table access, shared-folder tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_own_folder: list[str] = []
#: Of this process's tables in the shared folder.
_SESSION = uuid.uuid4().hex


#: Bytes of a batch that goes to a Python worker, unless the session says otherwise. Spark's own bound counts in rows, and ten
#: thousand long texts, copied on both sides and for each of an executor's cores, are much.
BATCH = "8m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers in bytes, where the session has Spark's default."""
    if spark.conf.get(_BATCH_BYTES) in ("67108864b", str(1 << 26)):
        spark.conf.set(_BATCH_BYTES, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in the one that driver and executors share, spark.checkpoint.dir; on one machine a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tagmill-"))
        root = "file://" + _own_folder[0]
    return f"{root.rstrip('/')}/tagmill/{_SESSION}"


def saved(df: DataFrame, name: str, codec: str = "zstd", **options: str | int) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: it cuts the lineage and survives lost executors.

    The write goes through Spark's committer, so repeated or speculative tasks leave one copy. The table stays until
    release() is called, because the returned frame reads it lazily. options are the Parquet writer's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer thinks that df takes, in bytes: the files' sizes where it reads files; 0 where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def release(spark: SparkSession) -> None:
    """Delete every table that saved() wrote in this session; frames that read them are void afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays while its executor runs other stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


_trim = _libc()


def driver_gives_back(spark: SparkSession) -> bool:
    """Return what the driver's JVM has freed outside its heap to the system; False where that JVM has no such command.

    Each thread that plans and compiles a query leaves some freed MB in its own arena of malloc's.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    lang, management = jvm.java.lang, jvm.javax.management

    def filled(kind, *values):
        out = array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:  # by the interface, as the server's own class is closed to callers
        named = lang.Class.forName
        types = filled(lang.Class, named("javax.management.ObjectName"), named("java.lang.String"), named("[Ljava.lang.Object;"), named("[Ljava.lang.String;"))
        command = named("javax.management.MBeanServer").getMethod("invoke", types)
        of = management.ObjectName("com.sun.management:type=DiagnosticCommand")
        command.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), filled(lang.Object, of, "systemTrimNativeHeap", array(lang.Object, 0), array(lang.String, 0)))
    except Py4JError:
        return False
    return True


def giving_back(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """The function of a batch, with what it used given back after each."""

    @wraps(f)
    def wrapped(*args: pa.Array) -> pa.Array:
        try:
            return f(*args)
        finally:
            give_back()

    return wrapped


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    _, offsets, data = col.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (i, j) of rows with about `most` bytes together, at least one row each, so that work stays in bounds."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def lower_az(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
