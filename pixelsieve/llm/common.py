"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only where none is set and all runs on one machine (tests), a
    temporary one. On a cluster without that setting executors would have no folder in common: an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="pixelsieve-"))


#: Folders of intermediate tables that this process has written, for clean_up().
_WRITTEN: set[str] = set()


def table_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for an intermediate table, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Removes the intermediate tables of operators and of the pipeline that this process has written, and returns
    their number. Frames that still read them can't be used any more: call it when their results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in sorted(_WRITTEN):
        where = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(conf).delete(where, True))
        _WRITTEN.discard(path)
    return gone


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later uses don't run its plan again
    and a lost executor costs a file read. Its size counts as unknown then. A checkpoint would keep the optimiser's
    estimate, which for a join is the product of both sides: over rounds of joins the digits of that number grow
    exponentially and fill the driver's memory."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf.queryExecution().analyzed()
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    none = jvm.scala.Option.empty()
    plan = kept.copy(kept.output(), kept.rdd(), kept.outputPartitioning(), kept.outputOrdering(), kept.isStreaming(), kept.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


def unique_names(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df whose columns can be told apart by name, and what gives a frame of the same columns the old names. Of
    columns with one name (names differ by more than case) the first keeps it; names with other characters than
    letters, digits and underscores are put off too."""
    seen, names = set(), []
    for k, c in enumerate(df.columns):
        names.append(c if c.lower() not in seen and c.replace("_", "a").isalnum() else f"__column{k}")
        seen.add(c.lower())
    old = df.columns
    if names == old:
        return df, lambda out: out
    return df.toDF(*names), lambda out: out.toDF(*old)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; other columns can't clash with an operator's own."""
    df, _ = unique_names(df)
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


#: What forgets the values that a worker remembers, by the modules that use them.
_MEMOS: dict[Callable[[], None], tuple[str, ...]] = {}


def remember_for(*modules: str):
    """Marks a cached function (of functools) whose values live as long as a worker runs tasks of these modules."""

    def put(cached):
        _MEMOS[cached.cache_clear] = modules
        return cached

    return put


def tidied(run):
    """A function over batches for workers that live on: what other operators remember is forgotten when a task
    begins, and freed memory is handed back to the system when it ends, as both would count against the executor."""

    @functools.wraps(run)
    def wrapped(batches):
        for forget, modules in _MEMOS.items():
            if run.__module__ not in modules:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


def batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    """A record batch of Python lists or numpy arrays."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def utf8_views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each string of an Arrow column without copies; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = "q"
    else:
        kind = "i"
    valid, offsets, data = column.buffers()
    at = memoryview(offsets).cast("B").cast(kind) if offsets is not None else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    lo = column.offset
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        if nulls and nulls[i]:
            yield memoryview(b"")
        else:
            yield view[at[lo + i] : at[lo + i + 1]]
