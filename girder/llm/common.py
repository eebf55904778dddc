"""What the operators of this subpackage share: tables, scratch space, worker paths."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [REPO, env.get("PYTHONPATH", "")]))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        known = sc._jsc.sc().getCheckpointDir()
        told = known.get() if known.isDefined() else None
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="girder-")
        sc.setCheckpointDir(told)
    return told.rstrip("/")


class _Scopes(threading.local):
    """The folders that each open scoped call of this thread has written, innermost last."""

    def __init__(self):
        self.open: list[list[tuple]] = []


_scopes = _Scopes()
_settings_lock = threading.Lock()
_settings_before: list[dict] = []


def scoped(f):
    """Notes what f keep()s with the DataFrame that it returns, for release(). Nothing is deleted without that call
    before the application ends, so whatever is made from the result can be read as long as the application runs."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        mine: list[tuple] = []
        _scopes.open.append(mine)
        try:
            out = f(*args, **kwargs)
            out._scratch = mine
            return out
        finally:
            _scopes.open.pop()
            if _scopes.open:
                _scopes.open[-1].extend(mine)

    return run


def release(result: DataFrame) -> None:
    """Delete the tables behind the result of a scoped function; it and what is made from it cannot be read any more."""
    _delete(getattr(result, "_scratch", []))


def discard(*kept: DataFrame) -> None:
    """Delete tables that keep() has returned; nothing that reads them may be evaluated any more."""
    for df in kept:
        _delete(df._kept)


def _delete(paths: list[tuple]) -> None:
    while paths:
        system, where = paths.pop()
        system.delete(where, True)


@contextlib.contextmanager
def _write_settings(spark: SparkSession):
    """Shuffle files of a query go once its result is written, and batches of texts for Python stay small; restored
    when the last of several writing threads is done."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    with _settings_lock:
        _settings_before.append({} if _settings_before else {k: spark.conf.get(k, None) for k in settings})
        for k, v in settings.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _settings_lock:
            before = _settings_before.pop()
            if _settings_before:
                _settings_before[0] = _settings_before[0] or before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    The folder goes when the application ends, or by discard() or release().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/girder/{name}-{uuid.uuid4().hex}"
    with _write_settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(where)
    if _scopes.open:
        _scopes.open[-1].append((system, where))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = [(system, where)]
    return out


#: What an operator's tasks leave in their Python worker for its next tasks.
_resident: dict[str, object] = {}


def resident(name: str, make):
    """What was made under this name in this Python worker, or make() now."""
    if name not in _resident:
        _resident[name] = make()
    return _resident[name]


def give_back(but: str | None = None) -> None:
    """Return what a task has freed to the system: Python workers live on, and their peaks would add up.

    What is resident under another name than ``but`` is dropped: it belongs to an operator whose turn has passed.
    """
    import ctypes
    import gc

    for name in [n for n in _resident if n != but]:
        del _resident[name]
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def python_texts(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batches_of(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of one text or binary column, one row at least."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        offsets = batch.column(column).buffers()[1]
        arr = batch.column(column)
        width = 8 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else 4
        import numpy as np

        ends = np.frombuffer(offsets, np.int64 if width == 8 else np.int32)[arr.offset : arr.offset + n + 1]
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1
            stop = min(n, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop
