"""What the operators share: batches of texts, per-worker state, tables written in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII capitals and their small letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are taken from an Arrow batch in runs of about this many characters, so memory follows one run, not the batch.
RUN_CHARS = 2_000_000
#: Bytes of an Arrow batch between Spark and a worker, about; Spark's own bound (64 MB) is held several times over by each task, in the JVM and in its worker.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A table is sent to every task only if its rows were counted and are no more than this; beyond, joins shuffle.
SMALL_ROWS = 1_000_000

#: Seconds between two collections on the driver, at least.
CLEAN_S = 4

# Fixed values of the C library.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
_allocator: list = []
_state: dict = {}
_cleaned = 0.0
#: Where ``written`` has put tables.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def worker_state(key: tuple, build: Callable[[], object]):
    """What ``build`` gives, kept for as long as this Python worker lives, or until another of its kind (key[0]) is asked for."""
    kept = _state.get(key[0])
    if kept is None or kept[0] != key:
        _state.pop(key[0], None)
        kept = _state[key[0]] = (key, build())
    return kept[1]


def keep_pages() -> None:
    """Let this worker's allocator use memory again instead of asking the system for new pages for each array: with arrays of about a megabyte that costs more than the work on them."""
    if not _allocator:
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            libc = ctypes.CDLL("libc.so.6")
            _allocator.append((libc.mallopt(M_MMAP_THRESHOLD, 32 << 20), libc.mallopt(M_TRIM_THRESHOLD, 64 << 20)))


def forget(*but: str) -> None:
    """Give back what other operators have left in this worker: all kinds of state ``but`` these. Every task begins with this, as workers are used again by the stages of other operators."""
    keep_pages()
    gone = [k for k in _state if k not in but]
    for k in gone:
        del _state[k]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it; without it freed memory stays with the process
            ctypes.CDLL("libc.so.6").malloc_trim(0)


class Memo(dict):
    """Results by key that are worked out when first asked for; emptied when full, so memory is bounded."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def text_runs(texts: pa.Array, chars: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of about ``chars`` characters; null is empty."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    low, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= chars or i == len(lengths) - 1:
            yield low, [x or "" for x in texts.slice(low, i + 1 - low).to_pylist()]
            low, size = i + 1, 0


def map_texts(df: DataFrame, keep: list[str], text_col: str, make: Callable[[], Callable], key, fields: str) -> DataFrame:
    """The ``keep`` columns and, for each row, the columns that ``make()(texts)`` gives as lists in the order of ``fields`` (DDL).

    ``make()`` runs once for each worker and ``key``. Null texts arrive as ''.
    """
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *made])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches):
        forget(key[0])
        work = worker_state(key, make)
        for batch in batches:
            for low, texts in text_runs(batch.column(n)):
                kept = [batch.column(i).slice(low, len(texts)).cast(arrow.field(i).type) for i in range(n)]
                new = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(work(texts))]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def remainder(column: str, by: int) -> Column:
    """crc32 of the value as text, modulo ``by``; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir. Where that is unset, a local session (tests) gets one in /tmp; a cluster gets an error, as its machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/hourloom-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session to BATCH_BYTES; a lower bound of its own stays."""
    value = spark.conf.get(BATCH_SETTING, "64m").lower()
    parts = re.fullmatch(r"(-?\d+)([bkmg]?)b?", value)
    now = int(parts[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[parts[2]] if parts else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame, *partition_by: str, compression: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage is cut and nothing is computed twice. compression: a codec other than the session's."""
    global _cleaned
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    if time.monotonic() - _cleaned > CLEAN_S:
        # shuffle files stay on the executors' disks until the driver's JVM finds that nothing refers to them; nothing does now
        spark.sparkContext._jvm.System.gc()
        _cleaned = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def shrink(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage: they give back the heap that is then free, which the Python workers beside them need. Without this a heap stays as large as any stage before has made it."""
    tasks = 2 * spark.sparkContext.defaultParallelism  # so that each executor is likely to get one
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave, when all that was made of it has been written too."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``df`` (written), marked to be sent to every task if it has at most SMALL_ROWS rows (and elements of the list ``weight``); else as it is, to be joined by a shuffle."""
    n, elements = df.agg(F.count("*"), F.sum(F.size(weight)) if weight else F.lit(0)).first()
    return F.broadcast(df) if max(n, elements or 0) <= SMALL_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
