"""Helpers shared by the training-data operators: shared storage, text batches, streamed groups."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised helper works on at a time. Whole texts always: a longer text is a part of its own.
PART_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of our own, but
    only in local mode, as in tests: on a cluster executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glasspane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Whether Spark deletes an execution's shuffle files as soon as it has ended; else they wait for the driver's garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
    """Write to a new table in the shared folder and read that: cuts lineage, computes once and outlives executors.

    sweep: delete the shuffle files behind the table once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SWEEP, None)
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.set(SWEEP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 2 * PART_BYTES) -> None:
    """For stages that follow one another in the same executors: batches of `most` bytes at most, where 10,000 rows would else be
    held in the JVM and the worker at once, several times over. Rows stay whole."""
    spark.conf.set(BATCH_BYTES, str(most))


def release() -> None:
    """Give freed memory back to the system, which Arrow's pool and the C library else keep for the process's next work, on top of
    what the JVM beside it takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables, once all that was made of them is settled as well."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod m (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """Nulls become empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, no copies made."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def text_parts(arr: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes."""
    raw, off = utf8(arr)
    row, n = 0, len(arr)
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis; empty runs give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows for which keep(batch) is true, with all their columns."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[bool, pa.Table]]:
    """From batches sorted by keys: tables of whole groups, or, once a group has more than `most` rows, that group piece by piece.

    Yields (True, table of one or more whole groups) and (False, piece of one group that is too large to hold).
    """
    held: list[pa.Table] = []
    rows, large = 0, None

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def key_at(t: pa.Table, i: int) -> tuple:
        return tuple(t.column(k)[i].as_py() for k in keys)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        if large is not None:
            first = starts(t)
            stop = (int(first[1]) if len(first) > 1 else len(t)) if key_at(t, 0) == large else 0
            if stop:
                yield False, t.slice(0, stop)
                t = t.slice(stop)
                if not len(t):
                    continue
            large = None
        held.append(t)
        rows += len(t)
        if rows < most and len(held) < 64:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = int(starts(t)[-1])
        if last:
            yield True, t.slice(0, last)
            t = t.slice(last)
        held, rows = [t], len(t)
        if rows > most:
            large = key_at(t, 0)
            yield False, t
            held, rows = [], 0
    if held:
        yield True, pa.concat_tables(held).combine_chunks()


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets of the groups of a sorted table."""
    change = np.zeros(len(t) + 1, bool)
    change[0] = change[-1] = True
    for k in keys:
        v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        change[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
